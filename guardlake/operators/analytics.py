"""Dashboard analytics over decision events, configuration history and logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.fixed import traffic as fixed
from guardlake.functions import routing
from guardlake.session import materialized


def range_millis(name: str) -> int:
    return fixed.RANGE_MILLIS.get(name, fixed.RANGE_MILLIS[fixed.DEFAULT_RANGE])


def range_start(name: str, now: Column) -> Column:
    """Start of a rolling range."""
    return now - F.make_dt_interval(secs=F.lit(range_millis(name) / 1000))


def in_range(
    events: DataFrame, name: str, now: Column, surface: str | None = None, decision: str | None = None
) -> DataFrame:
    """Events of a range under the optional filters; all of them reach the scan."""
    work = events.where(F.col("ts") >= range_start(name, now))
    if surface:
        work = work.where(F.col("surface") == surface)
    if decision:
        work = work.where(F.col("decision") == decision)
    return work


def totals(events: DataFrame) -> DataFrame:
    """Counts over already filtered events."""
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("decision") == "redacted").alias("redactions"),
        F.count_if(F.col("decision") == "blocked").alias("blocks"),
    )


def volume_cards(events: DataFrame, now: Column) -> DataFrame:
    """Events per rolling range, whatever the other filters are: one pass."""
    names = {"today": "today", "7d": "d7", "30d": "d30"}
    return events.agg(
        *[F.count_if(F.col("ts") >= range_start(r, now)).alias(a) for r, a in names.items()]
    )


def bucket_start(ts: Column, name: str) -> Column:
    """Epoch-aligned bucket in milliseconds: an hour for today, else a day."""
    width = fixed.HOUR_MILLIS if name == "today" else fixed.DAY_MILLIS
    return F.floor(F.unix_millis(ts) / width) * width


def time_series(events: DataFrame, name: str) -> DataFrame:
    return (
        events.groupBy(bucket_start(F.col("ts"), name).alias("bucket"), "decision")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def pii_breakdown(events: DataFrame) -> DataFrame:
    return (
        events.select(F.explode("pii_types").alias("type"))
        .groupBy("type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def per_surface(events: DataFrame) -> DataFrame:
    """Over the range; the surface filter does not apply here."""
    return events.groupBy("surface").agg(
        F.count(F.lit(1)).alias("volume"),
        F.count_if(F.col("decision") == "blocked").alias("blocks"),
        F.count_if(F.col("decision") == "redacted").alias("redactions"),
        F.max("ts").alias("last_seen"),
    )


def newest(rows: DataFrame, key: str, limit: int | None) -> DataFrame:
    """Rows from the newest on, ties by the key downwards; the first ``limit`` if given."""
    ordered = rows.orderBy(F.col("ts").desc(), F.col(key).desc())
    return ordered if limit is None else ordered.limit(max(0, limit))


def query_events(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest events first; ties by event id."""
    return newest(events, "event_id", limit)


def query_audit(
    audit: DataFrame,
    admin: str | None = None,
    action: str | None = None,
    start: Column | None = None,
    end: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    work = audit
    if admin:
        work = work.where(F.col("admin") == admin)
    if action:
        work = work.where(F.col("action") == action)
    if start is not None:
        work = work.where(F.col("ts") >= start)
    if end is not None:
        work = work.where(F.col("ts") <= end)
    return newest(work, "audit_id", limit)


def recent(log: DataFrame, n: int, only_pii: bool = False) -> DataFrame:
    """The latest ``n`` rows of a log, of those with matches if asked for."""
    return newest(log.where("pii_detected") if only_pii else log, "id", n)


def surface_health(surfaces: DataFrame, now: Column) -> DataFrame:
    """Rates in per cent and a health label from the per-surface table."""
    age = F.unix_millis(now) - F.unix_millis(F.col("last_seen"))
    health = (
        F.when(F.col("volume") == 0, "no data")
        .when(age > fixed.HOUR_MILLIS, "stale")
        .otherwise("active")
    )

    def rate(part: str) -> Column:
        share = F.floor(F.col(part) * 100 / F.col("volume") + 0.5)
        return F.when(F.col("volume") == 0, 0).otherwise(share).cast("int")

    return surfaces.select(
        "surface",
        "volume",
        rate("blocks").alias("block_pct"),
        rate("redactions").alias("redaction_pct"),
        health.alias("health"),
    )


def series_pivot(series: DataFrame) -> DataFrame:
    """One row per bucket, one column per decision."""
    return (
        series.groupBy("bucket").pivot("decision", fixed.DECISIONS).sum("n").fillna(0, fixed.DECISIONS)
    )


def top_n_breakdown(counts: DataFrame, name: str, n: int = 14) -> DataFrame:
    return counts.orderBy(F.col("n").desc(), F.col(name)).limit(n)


def latency_stats(events: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Median and 95th percentile of the recorded latency per surface."""
    p = F.percentile_approx("latency_ms", F.array(F.lit(0.5), F.lit(0.95)), accuracy)
    return (
        events.where(F.col("latency_ms").isNotNull())
        .groupBy("surface")
        .agg(F.count(F.lit(1)).alias("n"), p.alias("_p"))
        .select("surface", "n", F.col("_p")[0].alias("p50"), F.col("_p")[1].alias("p95"))
    )


def inspector_stats(traffic: DataFrame) -> DataFrame:
    return traffic.agg(
        F.count(F.lit(1)).alias("entries"), F.count_if("pii_detected").alias("pii_entries")
    )


# --- configuration ----------------------------------------------------------------------------------

CONFIG = ["enabled", "mode", "pii_type_toggles", "fail_mode"]


def surface_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, s, m) for i, (s, m) in enumerate(fixed.SURFACES)],
        "place int, surface string, modes array<string>",
    )


def default_config(surface: Column) -> Column:
    """Settings of a surface nobody changed yet."""
    redacts = F.array_contains(routing.modes_for(surface), "redact")
    return F.struct(
        F.lit(True).alias("enabled"),
        F.when(redacts, "redact").otherwise("block").alias("mode"),
        F.create_map().cast("map<string,boolean>").alias("pii_type_toggles"),
        F.lit("closed").alias("fail_mode"),
    )


def surface_config(history: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Current settings per surface from the patch history (surface, seq, ts, admin, settings).

    A patch holds null for what it leaves alone, so each setting comes from its latest non-null patch.
    """
    latest = history.groupBy("surface").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}")
            for c in CONFIG
        ],
        F.max_by(F.struct("admin", "ts"), "seq").alias("_by"),
    )
    work = surfaces.select("surface").join(latest, "surface", "left").withColumn(
        "_d", default_config(F.col("surface"))
    )
    return work.select(
        "surface",
        *[F.coalesce(F.col(f"_{c}"), F.col(f"_d.{c}")).alias(c) for c in CONFIG],
        F.coalesce("_by.admin", F.lit("system")).alias("updated_by"),
        F.col("_by.ts").alias("updated_at"),
    )


def apply_config_patch(
    current: DataFrame, patches: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """New settings and one audit row per change. ``patches`` has one row per surface."""
    new = {c: F.coalesce(F.col(f"p.{c}"), F.col(f"c.{c}"), F.col(f"_d.{c}")) for c in CONFIG}
    old = {c: F.coalesce(F.col(f"c.{c}"), F.col(f"_d.{c}")) for c in CONFIG}
    joined = current.alias("c").join(patches.alias("p"), "surface", "full_outer").withColumn(
        "_d", default_config(F.col("surface"))
    )
    changed = F.col("p.admin").isNotNull()
    settings = joined.select(
        "surface",
        *[v.alias(c) for c, v in new.items()],
        F.when(changed, F.col("p.admin")).otherwise(F.col("c.updated_by")).alias("updated_by"),
        F.when(changed, F.col("p.ts")).otherwise(F.col("c.updated_at")).alias("updated_at"),
    )
    audit = joined.where(changed).select(
        F.col("p.ts").alias("ts"),
        F.col("p.admin").alias("admin"),
        F.lit("surface_config.update").alias("action"),
        F.col("surface").alias("target"),
        F.to_json(F.struct("surface", *[v.alias(c) for c, v in old.items()])).alias("before_value"),
        F.to_json(F.struct("surface", *[v.alias(c) for c, v in new.items()])).alias("after_value"),
    )
    return settings, audit


def validate_modes(patches: DataFrame) -> DataFrame:
    """Add ``error``: null for a valid patch, else why it is refused. Refused patches stay as rows."""
    known = F.col("surface").isin([s for s, _ in fixed.SURFACES])
    modes = routing.modes_for(F.col("surface"))
    unknown = F.concat(F.lit('unknown surface "'), "surface", F.lit('"'))
    unfit = F.concat(
        F.lit('mode "'), "mode", F.lit('" not valid for '), "surface", F.lit(" (allowed: "),
        F.array_join(modes, ", "), F.lit(")"),
    )
    bad_mode = F.col("mode").isNotNull() & ~F.array_contains(modes, F.col("mode"))
    return patches.withColumn("error", F.when(~known, unknown).when(bad_mode, unfit))


def config_version(history: DataFrame) -> DataFrame:
    return history.agg(F.count(F.lit(1)).alias("version"))


# --- admission and security log ---------------------------------------------------------------------


# Windows of a block that is decided at once.
BLOCK_WINDOWS = 64


def allowed_attempts(
    attempts: DataFrame,
    most: int = fixed.ATTEMPTS_PER_WINDOW,
    window_millis: int = fixed.ATTEMPT_WINDOW_MILLIS,
) -> DataFrame:
    """Add ``admitted``: at most ``most`` admitted attempts per key and window; refused ones are free.

    Expects attempt_id, key and ts. Admission depends on earlier admissions, so it is decided in order, but only the
    admissions of one window matter. Time is cut into blocks of ``BLOCK_WINDOWS`` windows. Each block is decided by
    itself, from the last admissions that the block before hands over: none at first, and again wherever that changes,
    until nothing does. So a key that holds all rows is dealt over all tasks. Usually admissions fall into step after
    a few attempts and two or three rounds do; at worst there are as many rounds as blocks that follow each other, each
    deciding the changed blocks only.
    """
    work = attempts.select("attempt_id", "key", "ts", F.unix_millis("ts").alias("at")).withColumn(
        "block", F.floor(F.col("at") / (window_millis * BLOCK_WINDOWS))
    ).where(F.col("key").isNotNull() & F.col("block").isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in work.schema.fields}
    place = ["key", "block"]
    none = F.array().cast("array<bigint>")

    def decided(rows: DataFrame, given: DataFrame | None, whole: bool) -> DataFrame:
        """Every attempt with ``admitted``, or only what each block hands over: key, block, last."""

        def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            current, admitted = None, []
            for batch in batches:
                verdicts, handed = [], []
                for key, block, at, earlier in zip(batch["key"], batch["block"], batch["at"], batch["earlier"]):
                    if current is None or (key, block) != current:
                        if current is not None:
                            handed.append((*current, admitted))
                        current, admitted = (key, block), list(earlier)
                    admitted = [t for t in admitted if at - t < window_millis]
                    verdicts.append(len(admitted) < most)
                    if verdicts[-1]:
                        admitted.append(at)
                if whole:
                    out = batch[["attempt_id", "key", "ts"]].copy()
                    out["admitted"] = verdicts
                    yield out
                elif handed:
                    yield pd.DataFrame(handed, columns=["key", "block", "last"])
            if not whole and current is not None:
                yield pd.DataFrame([(*current, admitted)], columns=["key", "block", "last"])

        both = rows.withColumn("earlier", none) if given is None else rows.join(given, place, "left").withColumn("earlier", F.coalesce("earlier", none))
        shape = f"key {kinds['key']}, block bigint, last array<bigint>"
        if whole:
            shape = f"attempt_id {kinds['attempt_id']}, key {kinds['key']}, ts timestamp, admitted boolean"
        return both.repartition(*place).sortWithinPartitions(*place, "at", "attempt_id").mapInPandas(admit, shape)

    light = materialized(work.select("attempt_id", "key", "block", "at"), "attempts")
    handed = materialized(decided(light, None, False), "handed")
    there, given = handed.select(F.col("key").alias("_key"), F.col("block").alias("_block")), None
    while True:
        # What is older than a window when the next block begins does not count there.
        start = (F.col("block") + 1) * (window_millis * BLOCK_WINDOWS)
        last = F.filter("last", lambda t: start - t < window_millis)
        new = handed.withColumn("earlier", last).where(F.size("earlier") > 0)
        new = new.select("key", (F.col("block") + 1).alias("_next"), "earlier").join(
            there, (F.col("key") == F.col("_key")) & (F.col("_next") == F.col("_block")), "left_semi"
        )
        new = materialized(new.withColumnRenamed("_next", "block"), "given")
        known = new.limit(0) if given is None else given
        old = known.withColumnRenamed("earlier", "_old")
        changed = new.join(old, place, "full").where(~F.coalesce("earlier", none).eqNullSafe(F.coalesce("_old", none))).select(place)
        changed = materialized(changed, "changed")
        given = new
        if changed.isEmpty():
            break
        again = decided(light.join(changed, place, "left_semi"), given, False)
        handed = materialized(handed.join(changed, place, "left_anti").unionByName(again), "handed")
    return decided(work, given, True)


def security_rows(
    prompts: DataFrame, commands: DataFrame, findings: DataFrame, errors: DataFrame
) -> DataFrame:
    """One tagged log out of the four guards' rows; absent columns become null."""
    tagged = [
        (prompts, "prompt-guard"),
        (commands, "command-guard"),
        (findings, "action-guard"),
        (errors, "action-guard-error"),
    ]
    result = None
    for rows, kind in tagged:
        rows = rows.withColumn("kind", F.lit(kind))
        result = rows if result is None else result.unionByName(rows, allowMissingColumns=True)
    return result
