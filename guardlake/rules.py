"""Rule sets: which detectors run, in which order, and what is spared."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.fixed.pii import PII_PATTERNS
from guardlake.functions import validators
from guardlake.functions.regex import java_regex

RULE_SCHEMA = (
    "name string, pattern string, flags string, source string, enabled boolean, "
    "has_validator boolean, rule_rank int"
)
ALLOW_SCHEMA = "id string, pattern string, flags string, source string, enabled boolean"

Test = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    """One detector. ``guard`` is a cheap test that holds for every text with a match."""

    name: str
    pattern: str
    flags: str = ""
    java: str = ""
    validate: Test | None = None
    guard: Test | None = None
    source: str = "default"
    enabled: bool = True


@dataclass(frozen=True)
class AllowEntry:
    id: str
    pattern: str
    flags: str
    java: str
    source: str = "allow-ui"
    enabled: bool = True


def _has(*needles: str) -> Test:
    def test(text: Column) -> Column:
        result = F.contains(text, F.lit(needles[0]))
        for needle in needles[1:]:
            result = result & F.contains(text, F.lit(needle))
        return result

    return test


def _shows(pattern: str) -> Test:
    return lambda text: text.rlike(pattern)


_VALIDATORS: dict[str, Test] = {
    "CREDIT_CARD": validators.luhn_valid,
    "AADHAAR": validators.verhoeff_valid,
    "IPV4": validators.is_public_ipv4,
    "IPV6": validators.is_public_ipv6,
}
# Nine digits with nothing but separators between them: the shortest of the long numbers has them.
_LONG_NUMBER = _shows(r"[0-9](?:[-.()\s\x{FEFF}\p{Z}]*+[0-9]){8}")
_GUARDS: dict[str, Test] = {
    "PRIVATE_KEY": _has("-----BEGIN ", "-----END "),
    "JWT": _has("eyJ"),
    "CONN_STRING": _has("://", "@"),
    "BEARER_TOKEN": _has("Bearer"),
    "EMAIL": _has("@"),
    "PHONE_US": _LONG_NUMBER,
    "PHONE_IN": _has("+91"),
    "CREDIT_CARD": _LONG_NUMBER,
    "SSN": _LONG_NUMBER,
    "PAN_IN": _shows("[A-Z][0-9]{4}[A-Z]"),
    "AADHAAR": _LONG_NUMBER,
    "IPV4": _shows(r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"),
    "IPV6": lambda text: F.contains(text, F.lit(":"))
    & (F.contains(text, F.lit("::")) | text.rlike(":[0-9A-Fa-f]{1,4}:")),
}
# The plain form rescans a long run once per start. Starting only where a run starts, or where the last
# match ended, finds the same matches in one pass.
_LINEAR_FORMS = {
    "EMAIL": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}


def default_rules() -> tuple[Rule, ...]:
    return tuple(
        Rule(
            name,
            pattern,
            flags,
            java=_LINEAR_FORMS.get(name) or java_regex(pattern, flags),
            validate=_VALIDATORS.get(name),
            guard=_GUARDS.get(name),
        )
        for name, pattern, flags in PII_PATTERNS
    )


def _compiled(pattern: str, flags: str | None) -> str:
    """Java form of a user's pattern; raises ValueError if the JVM refuses it."""
    java = java_regex(pattern, (flags or "").replace("g", ""))
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(java)
        except Exception as error:
            raise ValueError(f"bad regex: {pattern}") from error
    return java


@dataclass(frozen=True)
class RuleSet:
    """An immutable, ordered rule list and an allowlist. Every edit returns a new set."""

    rules: tuple[Rule, ...] = field(default_factory=default_rules)
    allow: tuple[AllowEntry, ...] = ()

    @property
    def active(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.enabled)

    @property
    def allow_patterns(self) -> tuple[str, ...]:
        return tuple(a.java for a in self.allow if a.enabled)

    def _index(self, name: str) -> int:
        for i, rule in enumerate(self.rules):
            if rule.name == name:
                return i
        raise KeyError(name)

    def add(
        self,
        name: str,
        pattern: str,
        flags: str | None = None,
        validate: Test | None = None,
        source: str = "custom-ui",
    ) -> RuleSet:
        """Put a custom rule ahead of all others, so that it wins equal spans."""
        if not name or not pattern:
            raise ValueError('both "name" and "pattern" are required')
        if any(r.name == name for r in self.rules):
            raise ValueError(f'a rule named "{name}" already exists')
        rule = Rule(name, pattern, flags or "", _compiled(pattern, flags), validate, source=source)
        return replace(self, rules=(rule, *self.rules))

    def remove(self, name: str) -> RuleSet:
        i = self._index(name)
        if self.rules[i].source == "default":
            raise ValueError("default rules cannot be removed (disable instead)")
        return replace(self, rules=self.rules[:i] + self.rules[i + 1 :])

    def set_enabled(self, name: str, enabled: bool) -> RuleSet:
        i = self._index(name)
        changed = replace(self.rules[i], enabled=enabled)
        return replace(self, rules=self.rules[:i] + (changed,) + self.rules[i + 1 :])

    def only(self, *names: str) -> RuleSet:
        """Enable the named rules and disable the others."""
        return replace(self, rules=tuple(replace(r, enabled=r.name in names) for r in self.rules))

    def with_rules_json(self, text: str, source: str = "custom-file") -> RuleSet:
        """Custom rules from a JSON array; any bad entry fails the whole list."""
        try:
            entries = json.loads(text)
        except ValueError as error:
            raise ValueError(f"Invalid {source} JSON: {error}") from error
        if not isinstance(entries, list):
            raise ValueError(f"{source} must be a JSON array")
        custom = []
        for i, entry in enumerate(entries):
            name = entry.get("name") if isinstance(entry, dict) else None
            pattern = entry.get("pattern") if isinstance(entry, dict) else None
            if not isinstance(name, str) or not isinstance(pattern, str):
                raise ValueError(f'{source}[{i}] needs string "name" and "pattern"')
            flags = entry.get("flags")
            custom.append(Rule(name, pattern, flags or "", _compiled(pattern, flags), source=source))
        return replace(self, rules=(*custom, *self.rules))

    def with_allowlist_json(self, text: str) -> RuleSet:
        """Allowlist entries from a JSON array; bad entries are skipped."""
        try:
            entries = json.loads(text)
        except ValueError:
            entries = []
        result = self
        for entry in entries if isinstance(entries, list) else []:
            if not isinstance(entry, dict) or not isinstance(entry.get("pattern"), str):
                continue
            try:
                result = result.add_allow(entry["pattern"], entry.get("flags"), source="allow-env")
            except ValueError:
                continue
        return result

    def add_allow(self, pattern: str, flags: str | None = None, source: str = "allow-ui") -> RuleSet:
        if not pattern:
            raise ValueError('"pattern" is required')
        last = max((int(a.id[1:]) for a in self.allow), default=0)
        entry = AllowEntry(f"a{last + 1}", pattern, flags or "", _compiled(pattern, flags), source)
        return replace(self, allow=(*self.allow, entry))

    def set_allow_enabled(self, entry_id: str, enabled: bool) -> RuleSet:
        return replace(
            self,
            allow=tuple(replace(a, enabled=enabled) if a.id == entry_id else a for a in self.allow),
        )

    def remove_allow(self, entry_id: str) -> RuleSet:
        return replace(self, allow=tuple(a for a in self.allow if a.id != entry_id))

    def rules_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (r.name, r.pattern, r.flags, r.source, r.enabled, r.validate is not None, i)
            for i, r in enumerate(self.rules)
        ]
        return spark.createDataFrame(rows, RULE_SCHEMA)

    def allow_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(a.id, a.pattern, a.flags, a.source, a.enabled) for a in self.allow]
        return spark.createDataFrame(rows, ALLOW_SCHEMA)
