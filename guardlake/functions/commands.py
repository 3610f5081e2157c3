"""Shell command classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake.fixed import commands as fixed
from guardlake.functions.expr import any_of, found, found_with, let

VERDICT = (
    "struct<permission:string,category:string,matched_pattern:string,"
    "user_message:string,agent_message:string>"
)


def trips_category(command: Column, category: str) -> Column:
    """True when the command matches any pattern of one category."""
    entry = next(e for e in fixed.COMMAND_CATEGORIES if e["category"] == category)
    return any_of(found(command, p, f) for p, f in entry["patterns"])


def _verdict(permission, category, pattern, user_message, agent_message) -> Column:
    return F.struct(*map(F.lit, (permission, category, pattern, user_message, agent_message))).cast(
        VERDICT
    )


def classify_command(command: Column) -> Column:
    """First matching pattern in table order decides; a blank command and no match mean allow."""
    table = [(entry, pattern, flags) for entry in fixed.COMMAND_CATEGORIES for pattern, flags in entry["patterns"]]
    verdicts = [
        _verdict(entry["permission"], entry["category"], pattern, entry["user_message"], entry["agent_message"])
        for entry, pattern, _ in table
    ]
    allow = _verdict("allow", None, None, "", "")

    def first(t: Column) -> Column:
        which = None
        for index, (_, pattern, flags) in enumerate(table):
            hit = found_with(t["text"], t["low"], pattern, flags)
            which = F.when(hit, index) if which is None else which.when(hit, index)
        return which

    # No pattern matches a blank command.
    index = let(F.struct(command.alias("text"), F.lower(command).alias("low")), first)
    return let(index, lambda i: F.when(i.isNull(), allow).otherwise(F.get(F.array(*verdicts), i)))


def guard_command(command: Column) -> Column:
    """As ``classify_command``, but a command that could not be read is denied."""
    deny = _verdict(
        "deny", None, None, fixed.UNREADABLE_USER_MESSAGE, fixed.UNREADABLE_AGENT_MESSAGE
    )
    return F.when(command.isNull(), deny).otherwise(classify_command(command))
