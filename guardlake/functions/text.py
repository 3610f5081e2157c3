"""Scalar text functions: slugs, snapshots, hashes, credentials in URLs, leftover detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake.fixed.pii import (
    CREDENTIAL_PARAMS,
    CREDENTIAL_TOKEN,
    PEM_HEADER,
    PII_PATTERNS,
    PII_TYPE_SHAPE,
)
from guardlake.fixed.turns import HASH_CHARS
from guardlake.functions.expr import all_matches, any_of, let
from guardlake.functions.regex import java_regex
from guardlake.functions.validators import luhn_valid
from guardlake.rules import default_rules


def snapshot(text: Column, cap: int) -> Column:
    """The first ``cap`` characters; 0 means all."""
    return F.substring(text, 1, cap) if cap > 0 else text


def slug(text: Column, keep_dots: bool = True) -> Column:
    """Lower case, everything else than letters, digits (and dots) folded to single dashes."""
    other = "[^a-z0-9.]+" if keep_dots else "[^a-z0-9]+"
    return F.regexp_replace(F.regexp_replace(F.lower(text), other, "-"), r"^-+|-+\z", "")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, HASH_CHARS)


def residual_pii(text: Column) -> Column:
    """True while an e-mail address, SSN, JWT, PEM header or Luhn-valid card is left in the text."""
    rules = {r.name: r for r in default_rules()}
    patterns = {name: (pattern, flags) for name, pattern, flags in PII_PATTERNS}
    shapes = [rules[n].guard(text) & text.rlike(rules[n].java) for n in ("EMAIL", "SSN", "JWT")]
    shapes.append(F.contains(text, F.lit("-----BEGIN ")) & text.rlike(java_regex(PEM_HEADER)))
    cards = F.exists(all_matches(text, *patterns["CREDIT_CARD"]), luhn_valid)
    return F.coalesce(any_of([*shapes, rules["CREDIT_CARD"].guard(text) & cards]), F.lit(False))


def sanitize_pii_types(names: Column) -> Column:
    """Distinct, token-shaped names in first-seen order: a raw value cannot get through."""
    kept = F.filter(names, lambda n: n.rlike(PII_TYPE_SHAPE.replace("$", r"\z")))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def redact_url_credentials(path: Column) -> Column:
    """Mask credential query parameters. A path without any is returned unchanged.

    A repeated credential name keeps its first place only; the query is re-encoded.
    """
    query = F.regexp_extract(path, r"^[^?]*\?([\s\S]*)\z", 1)

    def pair(part: Column) -> Column:
        at = F.instr(part, "=")
        name = F.when(at > 0, F.substring(part, F.lit(1), at - 1)).otherwise(part)
        value = F.when(at > 0, F.substring(part, at + 1, F.length(part))).otherwise("")
        return F.struct(_decoded(name).alias("name"), _decoded(value).alias("value"))

    def secret(p: Column) -> Column:
        return F.lower(p["name"]).isin(CREDENTIAL_PARAMS)

    def rebuild(pairs: Column) -> Column:
        names = F.transform(pairs, lambda p: p["name"])
        kept = F.filter(
            pairs, lambda p, i: ~secret(p) | (F.array_position(names, p["name"]) == i + 1)
        )
        parts = F.transform(
            kept,
            lambda p: F.concat(
                F.url_encode(p["name"]),
                F.lit("="),
                F.url_encode(F.when(secret(p), CREDENTIAL_TOKEN).otherwise(p["value"])),
            ),
        )
        base = F.regexp_extract(path, r"^[^?]*", 0)
        masked = F.concat(base, F.lit("?"), F.array_join(parts, "&"))
        return F.when(F.exists(pairs, secret), masked).otherwise(path)

    pairs = F.transform(F.filter(F.split(query, "&", -1), lambda s: s != ""), pair)
    return F.when(F.contains(path, F.lit("?")), let(pairs, rebuild)).otherwise(path)


def _decoded(part: Column) -> Column:
    """Form decoding; text with a malformed escape stays as written, spaces aside."""
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))
