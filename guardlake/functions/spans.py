"""Find every match with its offsets, settle overlaps, rewrite the text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake.fixed.pii import INBOUND_PREFIX, INBOUND_SUFFIX, OUTBOUND_TOKEN
from guardlake.functions.expr import any_of, let

SPAN = "struct<start:int,end:int,rule:string,rank:int>"
SPANS = f"array<{SPAN}>"
COUNTS = "map<string,int>"
HITS = (
    "array<struct<rule:string,rank:int,gaps:array<string>,values:array<string>,"
    "refused:array<boolean>>>"
)


def no_spans() -> Column:
    return F.array().cast(SPANS)


def _blocks(items: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(block number, block width)`` for blocks about as many as they are wide.

    Appending to an array copies it, and finding a character walks the text. Both are done per block, so a
    text with very many matches costs n * sqrt(n) instead of n * n.
    """
    width = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(items).cast("double")))).cast("int")

    def run(w: Column) -> Column:
        last = F.greatest(F.floor((F.size(items) - 1) / w).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda b: body(b, w))

    return let(width, run)


def fold_spans(items: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fold items, in order, with a state of a position and the spans so far."""

    def folded(all_items: Column) -> Column:
        def append(acc: Column, block: Column) -> Column:
            start = F.struct(acc["at"].alias("at"), no_spans().alias("spans"))
            return let(
                F.aggregate(block, start, step),
                lambda r: F.struct(
                    r["at"].alias("at"),
                    F.concat(acc["blocks"], F.array(r["spans"])).alias("blocks"),
                ),
            )

        blocks = _blocks(all_items, lambda b, w: F.slice(all_items, b * w + 1, w))
        zero = F.struct(
            F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("blocks")
        )
        return F.aggregate(blocks, zero, append, lambda acc: F.flatten(acc["blocks"]))

    return let(items, folded)


def allowlisted(value: Column, patterns: Sequence[str]) -> Column:
    """True when any allowlist pattern matches somewhere in the value."""
    return any_of(value.rlike(p) for p in patterns)


def rule_hits(text: Column, rule, rank: int) -> Column:
    """Matches of one rule and the gaps around them; null when there is none."""

    def hits(values: Column) -> Column:
        refused = F.array().cast("array<boolean>")
        if rule.validate:
            refused = F.transform(values, lambda v: ~rule.validate(v))
        found = F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(rank).alias("rank"),
            F.split(text, rule.java, -1).alias("gaps"),
            values.alias("values"),
            refused.alias("refused"),
        )
        return F.when(F.size(values) > 0, found)

    return let(F.regexp_extract_all(text, F.lit(rule.java), F.lit(0)), hits)


def spans_of(hits: Column, allow: Sequence[str] = ()) -> Column:
    """Spans out of the hits of one rule.

    Gaps and matches alternate, so running lengths give the offsets. A match that was refused, or an empty
    one, still moves the position on but yields no span.
    """
    # No gap is reported before an empty match at the very start of the text.
    values = F.when(F.size(hits["gaps"]) > F.size(hits["values"]), hits["values"]).otherwise(
        F.slice(hits["values"], F.lit(2), F.size(hits["values"]))
    )
    pairs = F.zip_with(
        hits["gaps"], values, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value"))
    )
    pieces = F.zip_with(
        pairs, hits["refused"], lambda p, r: F.struct(p["gap"], p["value"], r.alias("refused"))
    )

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + piece["gap"]
        end = start + F.coalesce(F.length(piece["value"]), F.lit(0))
        good = (end > start) & ~F.coalesce(piece["refused"], F.lit(False))
        if allow:
            good = good & ~allowlisted(piece["value"], allow)
        span = F.struct(start.alias("start"), end.alias("end"), hits["rule"], hits["rank"])
        spans = F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return fold_spans(pieces, step)


def find_spans(text: Column, rules, allow: Sequence[str] = ()) -> Column:
    """All spans of all rules (``guardlake.rules.Rule``, in registry order), possibly overlapping.

    Rules with the same cheap guard sit behind one test, so most rows pay for a few searches only.
    """
    if not rules:
        return no_spans()
    groups: dict = {}
    for rank, rule in enumerate(rules):
        groups.setdefault(rule.guard, []).append((rank, rule))
    guarded = []
    for guard, members in groups.items():
        hits = F.array(*[rule_hits(text, rule, rank) for rank, rule in members])
        if guard:
            hits = F.when(guard(text), hits).otherwise(F.array().cast(HITS))
        guarded.append(hits)
    fired = F.array_compact(F.concat(*guarded))
    spans = F.flatten(F.transform(fired, lambda h: spans_of(h, allow))).cast(SPANS)
    return F.when(text.isNull(), no_spans()).otherwise(spans)


def resolve_overlaps(spans: Column) -> Column:
    """Earliest start wins, then the longest, then the lowest rank; the rest is dropped."""
    return let(spans, _resolve)


def _resolve(spans: Column) -> Column:
    by_place = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), (-s["end"]).alias("back"), s["rank"], s["rule"]
            ),
        )
    )

    def step(acc: Column, s: Column) -> Column:
        span = F.struct(
            s["start"].alias("start"), (-s["back"]).alias("end"), s["rule"], s["rank"]
        )
        free = s["start"] >= acc["at"]
        return F.struct(
            F.when(free, -s["back"]).otherwise(acc["at"]).alias("at"),
            F.when(free, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.when(F.size(spans) < 2, spans).otherwise(let(by_place, lambda b: fold_spans(b, step)))


def token_for(rule: Column, direction: str) -> Column:
    if direction == "outbound":
        return F.lit(OUTBOUND_TOKEN)
    return F.concat(F.lit(INBOUND_PREFIX), rule, F.lit(INBOUND_SUFFIX))


def render(text: Column, kept: Column, direction: str = "inbound") -> Column:
    """The text with every kept span replaced by its token."""

    def end_before(i: Column) -> Column:
        return F.when(i == 0, 0).otherwise(F.get(kept, i - 1)["end"])

    def block(b: Column, w: Column) -> Column:
        def pieces(part: Column) -> Column:
            def piece(span: Column, i: Column) -> Column:
                last = F.when(i == 0, part["from"]).otherwise(F.get(part["spans"], i - 1)["end"])
                gap = F.substring(part["text"], last - part["from"] + 1, span["start"] - last)
                return F.concat(gap, token_for(span["rule"], direction))

            return F.array_join(F.transform(part["spans"], piece), "")

        def cut(part: Column) -> Column:
            end = F.element_at(part["spans"], -1)["end"]
            inside = F.substring(text, part["from"] + 1, end - part["from"])
            return F.struct(part["from"], part["spans"], inside.alias("text"))

        part = F.struct(
            end_before(b * w).alias("from"), F.slice(kept, b * w + 1, w).alias("spans")
        )
        return let(let(part, cut), pieces)

    last = F.get(kept, F.size(kept) - 1)["end"]
    tail = F.substring(text, last + 1, F.length(text))
    whole = F.concat(F.array_join(_blocks(kept, block), ""), tail)
    return F.when(F.size(kept) == 0, text).otherwise(whole)


def match_counts(kept: Column) -> Column:
    """Matches per rule as a map."""
    rules = F.transform(kept, lambda s: s["rule"])
    return F.map_from_entries(
        F.transform(
            F.array_distinct(rules),
            lambda r: F.struct(r, F.size(F.filter(rules, lambda x: x == r))),
        )
    ).cast(COUNTS)


def merge_counts(left: Column, right: Column) -> Column:
    """Per-key sum of two count maps; a null map counts as empty."""
    empty = F.create_map().cast(COUNTS)
    zero = F.lit(0)
    return F.map_zip_with(
        F.coalesce(left, empty),
        F.coalesce(right, empty),
        lambda _, a, b: F.coalesce(a, zero) + F.coalesce(b, zero),
    )


def has_matches(counts: Column) -> Column:
    return F.coalesce(F.size(counts), F.lit(0)) > 0


def redacted(text: Column, rules, direction: str = "inbound", allow: Sequence[str] = ()) -> Column:
    """``struct<text, matched>`` for one string, usable inside ``transform`` and friends."""

    def rewrite(t: Column) -> Column:
        return let(
            resolve_overlaps(find_spans(t, rules, allow)),
            lambda kept: F.struct(
                render(t, kept, direction).alias("text"), match_counts(kept).alias("matched")
            ),
        )

    return let(text, rewrite)
