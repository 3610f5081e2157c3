"""Append decisions, audit rows and findings; export events."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from guardlake.operators.analytics import query_audit
from guardlake.operators.codescan import finding_audit
from guardlake.operators.traffic import normalize_decisions

EVENT_COLUMNS = [
    "id", "timestamp", "surface", "direction", "decision", "pii_types", "rule_matched", "latency_ms",
]


def append_decisions(events: DataFrame, path: str, now: Column | None = None) -> None:
    """Normalise and append; partitioned by day, so that range queries read only their days."""
    rows = normalize_decisions(events, now).withColumn("day", F.to_date("ts"))
    rows.write.mode("append").partitionBy("day").parquet(path)


def read_decisions(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    if since is not None:
        rows = rows.where((F.col("day") >= F.to_date(since)) & (F.col("ts") >= since))
    return rows.drop("day")


def events_for_csv(events: DataFrame) -> DataFrame:
    """The eight export columns as text."""
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        "surface",
        "direction",
        "decision",
        F.to_json("pii_types").alias("pii_types"),
        "rule_matched",
        F.col("latency_ms").cast("string").alias("latency_ms"),
    )


def csv_line(columns: list[str]) -> Column:
    """One CSV line: a value is quoted only if it holds a quote, a comma or a line end; null is empty."""

    def cell(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(value.rlike('[",\n]'), quoted).otherwise(value)

    return F.concat_ws(",", *[cell(c) for c in columns])


def write_events_csv(events: DataFrame, path: str) -> None:
    """CSV export with a header line in every part file."""
    events_for_csv(events).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue="", nullValue=""
    )


def append_audit(rows: DataFrame, path: str, now: Column | None = None) -> None:
    """Append-only log: audit_id, ts, admin, action, target, before_value, after_value."""
    now = F.current_timestamp() if now is None else now
    stamped = rows.withColumn("ts", F.coalesce("ts", now)) if "ts" in rows.columns else rows.withColumn(
        "ts", now
    )
    identity = F.concat_ws("|", F.col("ts").cast("string"), "admin", "action", "target", "after_value")
    stamped = stamped.withColumn("audit_id", F.xxhash64(identity))
    stamped.select(
        "audit_id", "ts", "admin", "action", "target", "before_value", "after_value"
    ).write.mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str, **filters) -> DataFrame:
    return query_audit(spark.read.parquet(path), **filters)


def write_findings(findings: DataFrame, keys: list[str], path: str) -> None:
    """Append one row per scanned file with findings, without the code."""
    finding_audit(findings, keys).write.mode("append").parquet(path)


FOLDERS = 256
# Stands for null; no other value is written like this.
_NULL = "__HIVE_DEFAULT_PARTITION__"


def write_text_files(rows: DataFrame, key: str, value: str, path: str, order: str | None = None) -> None:
    """A text file for every value of ``key``, named ``<key>=<value>.txt``: the lines of its rows, by ``order`` if given.

    The text sink makes a folder and a checksum file for each and starts two system processes per file to set rights on
    a local disk, so here the tasks write the files themselves. A hash of the key deals them over ``FOLDERS`` folders:
    a file's place does not depend on the task, so a task that runs again replaces its files.
    """
    # Hadoop writes local paths with one slash or none, pyarrow takes absolute ones.
    root = re.sub(r"^file:/+", "/", path)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = F.coalesce(F.col(key).cast("string"), F.lit(_NULL))
    named = rows.select(
        F.pmod(F.crc32(name.cast("binary")), F.lit(FOLDERS)).alias("folder"),
        name.alias("name"),
        (F.lit(0) if order is None else F.col(order)).alias("at"),
        F.coalesce(F.col(value), F.lit("")).alias("text"),
    )
    dealt = named.repartition(parts, "folder", "name").sortWithinPartitions("folder", "name", "at")

    def write(part: Iterator[Row]) -> None:
        store, base = fs.FileSystem.from_uri(root)
        made = set()
        for (folder, file), lines in groupby(part, lambda r: (r["folder"], r["name"])):
            into = f"{base}/{folder:03d}"
            if folder not in made:
                store.create_dir(into, recursive=True)
                made.add(folder)
            with store.open_output_stream(f"{into}/{key}={quote(file, safe=' ')}.txt") as out:
                for line in lines:
                    out.write(line["text"].encode("utf-8") + b"\n")

    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(base, recursive=True)
    dealt.foreachPartition(write)
