"""Files: office text, upload decisions and endpoint matching."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.fixed import files as fixed
from guardlake.functions import files, spans
from guardlake.rules import RuleSet
from guardlake.session import materialized

_PART = re.compile(fixed.OFFICE_TEXT_PART, re.IGNORECASE)


def office_archives(df: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """What office archives hold: keep..., readable, part_at, part, xml.

    Every archive has one row with a null part, which tells if all of its text could be read, and if so a row per
    text-bearing XML part. Archives come from strangers and can fail in any way: damaged data, wrong checksums,
    encryption, unknown compression, a missing end. Whatever it is, only that archive is not readable.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = ", ".join(f"`{k}` {kinds[k]}" for k in keep)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.itertuples(index=False):
                own, texts, readable = list(record[:-1]), [], True
                try:
                    with zipfile.ZipFile(io.BytesIO(record[-1])) as archive:
                        parts = [n for n in archive.namelist() if _PART.match(n)]
                        texts = [archive.read(n).decode("utf-8", "replace") for n in parts]
                except Exception:
                    texts, readable = [], False
                rows.append([*own, readable, -1, None, None])
                rows += [[*own, True, i, n, t] for i, (n, t) in enumerate(zip(parts, texts))] if readable else []
            yield pd.DataFrame(rows, columns=[*keep, "readable", "part_at", "part", "xml"])

    schema = f"{names}, readable boolean, part_at int, part string, xml string"
    return df.select(*keep, content).mapInPandas(read, schema)


def office_parts(df: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """Text-bearing XML parts of office archives: keep..., part_at, part, xml. Unreadable archives give none."""
    found = office_archives(df, keep, content)
    return found.where(F.col("part").isNotNull()).select(*keep, "part_at", "part", "xml")


def _unescaped(xml: Column) -> Column:
    text = xml
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    numbers = r"&#([0-9]+);"

    def numeric(t: Column) -> Column:
        codes = F.regexp_extract_all(t, F.lit(numbers), F.lit(1))
        chars = F.transform(codes, lambda c: _code_point(c.cast("int")))
        gaps = F.split(t, numbers, -1)
        return F.array_join(
            F.flatten(F.zip_with(gaps, chars, lambda g, c: F.array(g, F.coalesce(c, F.lit(""))))), ""
        )

    text = F.when(text.rlike(numbers), numeric(text)).otherwise(text)
    # Last, so that an escaped entity is not unescaped twice.
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _code_point(n: Column) -> Column:
    """Character of a code point, written as UTF-16 and decoded."""
    high = F.shiftright(n - 65536, 10) + 55296
    low = (n - 65536).bitwiseAND(F.lit(1023)) + 56320
    units = F.when(n < 65536, F.lpad(F.hex(n), 4, "0")).otherwise(F.concat(F.hex(high), F.hex(low)))
    return F.decode(F.unhex(units), "UTF-16BE")


def office_paragraphs(parts: DataFrame, keep: list[str]) -> DataFrame:
    """One row per paragraph with its runs joined, so that a value split over runs is whole again."""
    inner = F.regexp_extract_all("xml", F.lit(fixed.PARAGRAPH), F.lit(3))
    # Runs come out of the generator, or a filter on them would look for them a second time.
    runs = F.transform(inner, lambda p: F.regexp_extract_all(p, F.lit(fixed.TEXT_RUN), F.lit(3)))
    paragraphs = parts.select(*keep, "part_at", "part", F.posexplode_outer(runs).alias("at", "_runs"))
    plain = lambda run: F.when(F.contains(run, F.lit("&")), _unescaped(run)).otherwise(run)
    return paragraphs.where(F.size("_runs") > 0).select(
        *keep, "part_at", "part", "at", F.array_join(F.transform("_runs", plain), "").alias("text")
    )


def classify_files(df: DataFrame, text_most: int | None = None, office_most: int | None = None) -> DataFrame:
    """Add scannable, kind and reason from name, mime and size; larger files than allowed are not scannable."""
    verdict = files.classify_file(F.col("name"), F.col("mime"), F.col("size"), text_most, office_most)
    return df.withColumn("_c", verdict).select("*", "_c.*").drop("_c")


def redact_files(
    df: DataFrame, rules: RuleSet | None = None, text_most: int | None = None, office_most: int | None = None
) -> DataFrame:
    """Decide every file: file_id, action, reason, detail, text, paragraphs, matched.

    Expects file_id, name, mime, size and content (bytes). Text files are scanned whole and come back
    redacted. Office files are scanned by paragraph, and as they are not rewritten, one with matches is blocked;
    ``paragraphs`` counts those with matches. An archive that cannot be read is blocked, one that was read and
    holds no text passes. All others are blocked.
    """
    rules = rules or RuleSet()
    classified = classify_files(df, text_most, office_most)

    def scrub(text: Column) -> Column:
        return spans.redacted(text, rules.active, "inbound", rules.allow_patterns)

    text = F.when(F.col("kind") == "text", F.decode("content", "UTF-8"))
    plain = (
        classified.where(F.col("kind") != "ooxml")
        .withColumn("text", text)
        .withColumn("_r", scrub(F.col("text")))
        .select(
            "file_id", "scannable", "reason", "text", F.col("_r.text").alias("redacted"),
            F.when(F.col("text").isNotNull(), F.col("_r.matched")).alias("matched"),
            F.lit(None).cast("bigint").alias("paragraphs"),
        )
    )
    office_files = classified.where(F.col("kind") == "ooxml")
    # Read twice below: archives are opened once.
    archives = materialized(office_archives(office_files, ["file_id"]), "archives")
    paragraphs = office_paragraphs(archives.where(F.col("part").isNotNull()), ["file_id"])
    # One row per paragraph and rule; place 0 stands for the paragraph itself.
    per_rule = (
        paragraphs.withColumn("_r", scrub(F.col("text")))
        .select("file_id", F.posexplode_outer(F.map_entries("_r.matched")).alias("place", "m"))
        .groupBy("file_id", F.col("m.key").alias("rule"))
        .agg(F.sum("m.value").cast("int").alias("n"), F.count_if(F.col("place") == 0).alias("changed"))
    )
    counted = F.collect_list(F.when(F.col("rule").isNotNull(), F.struct("rule", "n")))
    summed = per_rule.groupBy("file_id").agg(
        F.map_from_entries(F.array_sort(counted)).alias("matched"),
        F.sum("changed").alias("paragraphs"),
    )
    opened = archives.where(F.col("part").isNull()).select("file_id", "readable")
    office = opened.join(summed, "file_id", "left").withColumn(
        "_d", files.decide_office(F.col("readable"), F.col("paragraphs").isNotNull(), spans.has_matches(F.col("matched")))
    )
    decision = files.decide_upload(
        F.col("scannable"), F.col("reason"), F.col("text"), F.lit(True), F.col("redacted"),
        spans.has_matches(F.col("matched")),
    )
    decided = ["file_id", "_d.action", "_d.reason", "_d.detail", "_d.text", "paragraphs", "matched"]
    return plain.withColumn("_d", decision).select(decided).unionByName(office.select(decided))


def match_endpoint(urls: DataFrame, url_col: str, endpoints=fixed.UPLOAD_ENDPOINTS) -> DataFrame:
    """Add ``sites``: every site with an endpoint the URL belongs to. The list is part of the plan."""
    hits = [
        F.when(files.matches_endpoint(F.col(url_col), F.lit(host), F.lit(path)), site)
        for site, host, path in endpoints
    ]
    return urls.withColumn("sites", F.array_distinct(F.array_compact(F.array(*hits))))
