"""Small helpers for nested expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake.functions.cuts import held_texts
from guardlake.functions.regex import ANY_SPACE, java_regex


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def array_of(items: Iterable, kind: str) -> Column:
    """A literal array with a known element type, also when empty."""
    return F.array(*[F.lit(i) for i in items]).cast(f"array<{kind}>")


def any_of(conditions: Iterable[Column]) -> Column:
    result = None
    for condition in conditions:
        result = condition if result is None else result | condition
    return F.lit(False) if result is None else result


def found(text: Column, pattern: str, flags: str = "") -> Column:
    """True where a JavaScript-dialect pattern matches somewhere in the text."""
    return text.rlike(java_regex(pattern, flags))


def found_with(text: Column, low: Column, pattern: str, flags: str = "") -> Column:
    """As ``found``, given the text in lower case: the pattern is tried only where its fixed texts occur."""
    there = [any_of(F.contains(low, F.lit(x)) for x in group) for group in held_texts(pattern, flags)]
    result = found(text, pattern, flags)
    for condition in reversed(there):
        result = condition & result
    return result


def js_trim(text: Column) -> Column:
    """Trim every kind of white space, line ends and the byte order mark included."""
    return F.regexp_replace(text, f"^[{ANY_SPACE}]+|[{ANY_SPACE}]+\\z", "")


def first_match(text: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    """First match or null. (Spark itself answers '' where nothing matches.)"""
    java = java_regex(pattern, flags)
    return F.when(text.rlike(java), F.regexp_extract(text, java, group))


def all_matches(text: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java_regex(pattern, flags)), F.lit(group))


def drop_matches(text: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_replace(text, java_regex(pattern, flags), "")


def keep_first(values: Column, wanted: Callable[[Column], Column]) -> Column:
    """First array element that satisfies the test, or null."""
    return F.get(F.filter(values, wanted), F.lit(0))

