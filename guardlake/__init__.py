"""Find, redact and audit sensitive data in model traffic, as Spark DataFrame operators."""

from guardlake.rules import Rule, RuleSet

__all__ = ["Rule", "RuleSet"]
