"""Checks that a matched value really is what its shape suggests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake.fixed.pii import VERHOEFF_PERMUTATION
from guardlake.functions.expr import let


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_valid(value: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten; other characters are ignored."""
    digits = _digits(value)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _dihedral_product(a: int, b: int) -> int:
    """Product in the symmetry group of the pentagon: 0-4 are turns, 5-9 are flips."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5


def verhoeff_tables() -> tuple[list[int], list[int]]:
    """The product table (100 entries) and the eight repeated permutations (80 entries), flattened."""
    product = [_dihedral_product(a, b) for a in range(10) for b in range(10)]
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([rows[-1][d] for d in VERHOEFF_PERMUTATION])
    return product, [d for row in rows for d in row]


def verhoeff_valid(value: Column) -> Column:
    """Exactly 12 digits that pass the Verhoeff check; other characters are ignored."""
    product, permuted = ("".join(map(str, table)) for table in verhoeff_tables())

    def digit_at(digits, place: Column) -> Column:
        return F.substring(F.lit(digits) if isinstance(digits, str) else digits, place, F.lit(1)).cast("int")

    def check(digits: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            place = (i % 8) * 10 + digit_at(digits, F.lit(12) - i)
            return digit_at(product, acc * 10 + digit_at(permuted, place + 1) + 1)

        total = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), step)
        return F.when(F.length(digits) == 12, total == 0).otherwise(False)

    return let(_digits(value), check)


def is_public_ipv4(value: Column) -> Column:
    """False for 127.x.x.x. A malformed address counts as public."""
    octet = "(?:[0-9]{1,2}|[01][0-9]{2}|2[0-4][0-9]|25[0-5])"
    loopback = rf"^0*127\.{octet}\.{octet}\.{octet}\z"
    return ~value.rlike(loopback)


def is_public_ipv6(value: Column) -> Column:
    """False for the unspecified address and for loopback in any spelling."""

    def check(groups: Column) -> Column:
        zeros = F.forall(
            F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 1, F.lit(0))),
            lambda g: g.rlike(r"^0+\z"),
        )
        last = F.get(groups, F.size(groups) - 1)
        return F.when(F.size(groups) == 0, False).otherwise(~(zeros & last.rlike(r"^0*1?\z")))

    return let(F.filter(F.split(value, ":", -1), lambda g: g != ""), check)
