"""Line-level code scan and findings returned by a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake.fixed import code as fixed
from guardlake.functions import payload
from guardlake.functions.expr import any_of, found, found_with, let
from guardlake.functions.risk import json_candidate

FINDING = "struct<tier:int,category:string,message:string,line:int>"


def trips_code_category(line: Column, category: str) -> Column:
    """True when one source line shows the defect."""
    entry = next(e for e in fixed.CODE_CATEGORIES if e["category"] == category)
    hit = any_of(found(line, p, f) for p, f in entry["patterns"])
    if category == "hardcoded_secret":
        hit = hit & ~found(line, fixed.SECRET_PLACEHOLDER, "i")
    return hit


def scan_code(content: Column) -> Column:
    """``array<struct<tier,category,message,line>>``: at most one finding per line and category."""
    none = F.array().cast(f"array<{FINDING}>")
    patterns = [(p, f) for e in fixed.CODE_CATEGORIES for p, f in e["patterns"]]
    numbers = iter(range(len(patterns)))
    categories = [(e, [next(numbers) for _ in e["patterns"]]) for e in fixed.CODE_CATEGORIES]

    def scan(text: Column, live: Column) -> Column:
        def scan_line(line: Column, i: Column) -> Column:
            found_here = []
            for e, own in categories:
                hit = any_of(live[f"p{n}"] & found(line, *patterns[n]) for n in own)
                if e["category"] == "hardcoded_secret":
                    hit = hit & ~found(line, fixed.SECRET_PLACEHOLDER, "i")
                finding = F.struct(
                    F.lit(1).alias("tier"), F.lit(e["category"]).alias("category"), F.lit(e["message"]).alias("message"),
                    (i + 1).alias("line"),
                )
                found_here.append(F.when(any_of(live[f"p{n}"] for n in own) & hit, finding))
            return F.array_compact(F.array(*found_here))

        lines = F.split(text, r"\r?\n", -1)
        findings = F.flatten(F.filter(F.transform(lines, scan_line), lambda x: F.size(x) > 0))
        return F.when(any_of(live[f"p{n}"] for n in range(len(patterns))), findings.cast(f"array<{FINDING}>")).otherwise(none)

    # A pattern that matches a line also matches the text around it, so a line is tried with those only that match
    # somewhere in the file, and clean files skip the split. Only anchors or look-around at line ends could break this,
    # and the table has none that do. No pattern matches a blank line.
    def of(t: Column) -> Column:
        tried = [found_with(t["text"], t["low"], p, f) for p, f in patterns]
        live = F.struct(*[F.coalesce(x, F.lit(False)).alias(f"p{n}") for n, x in enumerate(tried)])
        return let(live, lambda flags: scan(t["text"], flags))

    return let(F.struct(content.alias("text"), F.lower(content).alias("low")), of)


def parse_findings(reply: Column) -> Column:
    """Findings from a model's reply; null when the reply holds no findings array."""

    def one(f: Column) -> Column:
        line = payload.number_field(f, "$.line")
        return F.struct(
            F.lit(2).alias("tier"),
            payload.string_field(f, "$.category").alias("category"),
            payload.string_field(f, "$.message").alias("message"),
            F.when(line > 0, F.floor(line)).cast("int").alias("line"),
        )

    listed = payload.list_field(payload.parsed(json_candidate(reply)), "$.findings")
    return let(
        listed,
        lambda items: F.filter(
            F.transform(items, one), lambda f: f["category"].isNotNull() & f["message"].isNotNull()
        ),
    ).cast(f"array<{FINDING}>")
