"""Traffic rows, decision events and surface policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.fixed import traffic as fixed
from guardlake.functions import messages, payload, routing, spans
from guardlake.functions.text import redact_url_credentials, sanitize_pii_types, snapshot
from guardlake.rules import RuleSet
from guardlake.streaming.redaction import redact_bodies

DECISION_COLUMNS = [
    "ts", "surface", "direction", "decision", "pii_types", "rule_matched", "latency_ms",
]


def build_traffic(
    exchanges: DataFrame, rules: RuleSet | None = None, snapshot_chars: int = 0
) -> DataFrame:
    """Traffic rows from request/response pairs, holding redacted text only.

    Expects id, ts, provider, model, blocked, method, path, status, streaming, duration_ms, request and
    response. The clean view is taken from the full redacted bodies; with ``snapshot_chars`` the snapshots are cut.
    """
    rules = rules or RuleSet()
    allow = rules.allow_patterns
    # Step by step: the analyzer resolves nested lambdas one level per pass and stops at a hundred.
    given = exchanges.withColumns(
        {
            "_request": messages.drop_empty_blocks(F.coalesce("request", F.lit(""))),
            "_response": F.coalesce("response", F.lit("")),
        }
    )
    inbound = payload.redacted_json(F.col("_request"), rules.active, "inbound", allow)
    response = F.col("_response")
    is_stream = messages.is_event_stream(response)
    buffered = payload.redacted_json(
        F.when(~is_stream, response), rules.active, "outbound", allow
    )
    work = given.withColumns({"_in": inbound, "_body": buffered})
    # Values split over events are only visible along the stream, so recorded streams are redacted as such. Equal
    # bodies of a provider are one body, whatever their ids.
    name = F.when(is_stream, F.sha2(F.concat_ws("\n", "provider", "_response"), 256))
    # Other bodies meet nothing, and under a name of their own they do not all come to one task.
    work = work.withColumn("_name", F.coalesce(name, F.concat(F.lit("-"), F.xxhash64("id", "_response").cast("string"))))
    recorded = given.withColumn("_name", name).where(is_stream).select(
        F.col("_name").alias("stream_id"), "provider", F.col("_response").alias("chunk")
    )
    streamed = redact_bodies(recorded.dropDuplicates(["stream_id"]), rules).select(
        F.col("stream_id").alias("_name"), F.struct("text", "matched").alias("_sse")
    )
    work = work.join(streamed, "_name", "left")
    work = work.withColumn("_out", F.when(is_stream, F.col("_sse")).otherwise(F.col("_body")))
    request, response = F.col("_in.text"), F.col("_out.text")
    seen = spans.has_matches(F.col("_in.matched")) | spans.has_matches(F.col("_out.matched"))
    return work.select(
        "id",
        "ts",
        "provider",
        "model",
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
        F.lit(None).cast("boolean").alias("unchecked"),
        "method",
        redact_url_credentials(F.col("path")).alias("path"),
        "status",
        "streaming",
        "duration_ms",
        F.struct(
            F.length(request).alias("request"),
            F.length(response).alias("response"),
            (F.length(request) + F.length(response)).alias("total"),
        ).alias("char_count"),
        F.struct(
            snapshot(request, snapshot_chars).alias("request"),
            snapshot(response, snapshot_chars).alias("response"),
        ).alias("snapshot"),
        seen.alias("pii_detected"),
        F.struct(
            F.col("_in.matched").alias("inbound"), F.col("_out.matched").alias("outbound")
        ).alias("matched"),
        F.struct(
            messages.user_prompt(request).alias("user_prompt"),
            messages.assistant_output(F.col("provider"), response).alias("assistant_output"),
        ).alias("clean"),
    )


def to_decisions(traffic: DataFrame) -> DataFrame:
    """One decision event per traffic row, carrying rule names only."""
    inbound, outbound = F.col("matched.inbound"), F.col("matched.outbound")
    none = F.array().cast("array<string>")
    types = F.array_distinct(
        F.concat(F.coalesce(F.map_keys(inbound), none), F.coalesce(F.map_keys(outbound), none))
    )
    incoming = ~spans.has_matches(inbound) & spans.has_matches(outbound)
    decision = (
        F.when(F.col("blocked"), "blocked").when(F.col("pii_detected"), "redacted").otherwise("allowed")
    )
    return traffic.select(
        F.col("id").alias("event_id"),
        "ts",
        routing.surface_of(F.col("method"), F.col("path"), F.col("provider")).alias("surface"),
        F.when(incoming, "incoming").otherwise("outgoing").alias("direction"),
        decision.alias("decision"),
        types.alias("pii_types"),
        F.col("duration_ms").cast("double").alias("latency_ms"),
    )


def one_of(value: Column, allowed: list[str], fallback: str) -> Column:
    return F.when(value.isin(allowed), value).otherwise(fallback)


def normalize_decisions(events: DataFrame, now: Column | None = None) -> DataFrame:
    """Coerce incoming events to the decision schema; nothing is rejected."""
    now = F.current_timestamp() if now is None else now
    types = sanitize_pii_types(F.col("pii_types"))
    latency = F.col("latency_ms").cast("double")
    finite = ~F.isnan(latency) & (F.abs(latency) != float("inf"))
    own = [c for c in events.columns if c not in DECISION_COLUMNS]
    return events.select(
        *own,
        F.coalesce("ts", now).alias("ts"),
        F.coalesce(F.nullif("surface", F.lit("")), F.lit("unknown")).alias("surface"),
        one_of(F.col("direction"), fixed.DIRECTIONS, "outgoing").alias("direction"),
        one_of(F.col("decision"), fixed.DECISIONS, "allowed").alias("decision"),
        types.alias("pii_types"),
        F.when(finite, F.greatest(F.lit(0), F.floor(latency))).cast("bigint").alias("latency_ms"),
    ).withColumn(
        "rule_matched", F.when(F.size("pii_types") > 0, F.array_join("pii_types", ","))
    )


def apply_surface_policy(sends: DataFrame, config: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Add ``outcome``: blocked, raw or redact. A surface without a row, and a blank send, see below.

    ``sends`` holds surface and text; ``config`` one row per surface with enabled and mode. A surface without a
    row keeps the policy it had last, by its ``history`` of patches (surface, seq, enabled, mode); one that never
    had any means redact. A blank text cannot leak and passes raw.
    """
    policy = config.select(
        "surface", F.col("enabled").alias("_enabled"), F.col("mode").alias("_mode")
    )
    if history is not None:
        known = history.groupBy("surface").agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in ("enabled", "mode")]
        )
        policy = policy.unionByName(known.join(policy, "surface", "left_anti"))
    enabled = F.coalesce("_enabled", F.lit(True))
    mode = F.coalesce("_mode", F.lit("redact"))
    outcome = (
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "raw")
        .when(~enabled | (mode == "block"), "blocked")
        .when(mode == "off", "raw")
        .otherwise("redact")
    )
    return sends.join(policy, "surface", "left").withColumn("outcome", outcome).drop(
        "_enabled", "_mode"
    )
