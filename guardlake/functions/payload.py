"""JSON payloads of unknown shape: read fields, edit objects, rewrite string leaves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake.functions.expr import let
from guardlake.functions.spans import COUNTS, merge_counts, redacted


def parsed(raw: Column) -> Column:
    """JSON text as a variant; null when it does not parse.

    The parser stops after the first value. Both wrappings parse only if nothing but white space follows.
    """
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}")))
    in_array = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    return F.when(in_object.isNotNull(), F.try_variant_get(in_array, "$[0]", "variant"))


def field(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def kind_of(value: Column, path: str = "$") -> Column:
    """STRING, BOOLEAN, BIGINT, ARRAY<...>, OBJECT<...>, VOID, ... or null when absent."""
    return F.schema_of_variant(field(value, path))


def string_field(value: Column, path: str = "$") -> Column:
    """The field if it holds a string; numbers and the like are not converted."""
    return F.when(kind_of(value, path) == "STRING", field(value, path, "string"))


def number_field(value: Column, path: str = "$") -> Column:
    kind = kind_of(value, path)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(numeric, field(value, path, "double"))


def list_field(value: Column, path: str = "$") -> Column:
    """The field as an array of variants, null when it is no array."""
    return field(value, path, "array<variant>")


def is_object(value: Column, path: str = "$") -> Column:
    return F.coalesce(kind_of(value, path).startswith("OBJECT"), F.lit(False))


def json_text(value: Column) -> Column:
    """A string Column as a JSON string literal."""
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]\z", "")


def members(raw: Column) -> Column:
    """Top level of a JSON object as map<key, JSON text>, in the order of the text."""
    return F.transform_values(
        F.from_json(raw, "map<string,variant>"), lambda _, v: F.coalesce(F.to_json(v), F.lit("null"))
    )


def object_text(entries: Column) -> Column:
    """Inverse of ``members``."""
    pairs = F.transform(
        F.map_entries(entries), lambda e: F.concat(json_text(e["key"]), F.lit(":"), e["value"])
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def with_member(entries: Column, key: str, value: Column) -> Column:
    """Set one key: in place when present, at the end otherwise."""
    replaced = F.transform_values(entries, lambda k, v: F.when(k == key, value).otherwise(v))
    added = F.map_concat(entries, F.create_map(F.lit(key), value))
    return F.when(F.map_contains_key(entries, key), replaced).otherwise(added)


def without_member(entries: Column, key: str) -> Column:
    return F.map_filter(entries, lambda k, _: k != key)


def list_text(items: Column) -> Column:
    """An array of JSON texts as one JSON array."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def map_string_leaves(
    raw: Column, rewrite: Callable[[Column], Column], is_json: Column | None = None
) -> Column:
    """Apply ``rewrite`` to every string value of a JSON text; keys stay as they are.

    Where ``is_json`` is false the whole text is one string.

    ``rewrite`` maps a string to ``struct<text, matched>``. With escaped quotes and backslashes written
    as \\u escapes, quotes only delimit strings, so splitting at quotes separates strings from structure
    at any depth and in linear time. The result is ``struct<text, matched>`` for the whole payload, with
    insignificant white space removed.
    """
    is_json = F.lit(True) if is_json is None else is_json
    plain = F.replace(
        F.replace(raw, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022")
    )
    nothing = F.lit(None).cast(COUNTS)

    def pieces(parts: Column) -> Column:
        """Structure, keys and values in order, values unescaped."""

        def piece(body: Column, i: Column) -> Column:
            string = F.when(
                F.contains(body, F.lit("\\")),
                F.get(F.from_json(F.concat(F.lit('["'), body, F.lit('"]')), "array<string>"), F.lit(0)),
            ).otherwise(body)
            is_key = F.get(parts, i + 1).rlike(r"^\s*:")
            kind = F.when(i % 2 == 0, "outside").when(is_key, "key").otherwise("value")
            return F.struct(kind.alias("kind"), F.when(i % 2 == 0, body).otherwise(string).alias("body"))

        return F.transform(parts, piece)

    def written(p: Column) -> Column:
        outside = F.regexp_replace(p["body"], r"\s+", "")
        kept = F.struct(
            F.when(p["kind"] == "outside", outside).otherwise(json_text(p["body"])).alias("text"),
            nothing.alias("matched"),
        )
        scrubbed = let(
            rewrite(p["body"]),
            lambda r: F.struct(
                F.when(p["kind"] == "raw", r["text"]).otherwise(json_text(r["text"])).alias("text"),
                r["matched"].alias("matched"),
            ),
        )
        return F.when(p["kind"].isin("value", "raw"), scrubbed).otherwise(kept)

    whole = F.array(F.struct(F.lit("raw").alias("kind"), raw.alias("body")))
    chosen = F.when(is_json, let(F.split(plain, '"', -1), pieces)).otherwise(whole)
    return let(
        F.transform(chosen, written),
        lambda leaves: F.struct(
            F.array_join(F.transform(leaves, lambda x: x["text"]), "").alias("text"),
            sum_counts(F.transform(leaves, lambda x: x["matched"])).alias("matched"),
        ),
    )


def sum_counts(maps: Column) -> Column:
    """Add up an array of count maps; null maps are skipped."""
    return F.aggregate(
        F.filter(maps, lambda m: F.size(m) > 0),
        F.create_map().cast(COUNTS),
        lambda acc, m: merge_counts(acc, m),
    )


def redacted_json(raw: Column, rules, direction: str = "inbound", allow: Sequence[str] = ()) -> Column:
    """``struct<text, matched>``: string leaves redacted, or the raw text where it is no JSON."""

    def scrub(text: Column) -> Column:
        return redacted(text, rules, direction, allow)

    # Text that does not parse is treated as one string, so both ways share one scrub.
    return let(raw, lambda r: map_string_leaves(r, scrub, parsed(r).isNotNull()))
