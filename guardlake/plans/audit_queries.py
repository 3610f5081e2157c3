"""Queries over decision analytics, configuration, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardlake.functions import payload
from guardlake.operators import analytics, codescan, commands
from guardlake.plans import guard_queries, inputs, traffic_queries
from guardlake.plans.pii_queries import counts_text
from guardlake.session import STATE_STORE, materialized, packed, shared_dir
from guardlake.sources import readers, writers
from guardlake.streaming import events, redaction
from guardlake.streaming import operators as streaming

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def now():
    """The end of the given event data."""
    return F.timestamp_seconds(F.lit(1706659200))


def _ranged(spark, sf_dir, name="7d", surface=None, decision=None):
    return analytics.in_range(inputs.decisions(spark, sf_dir), name, now(), surface, decision)


@query
def range_starts(spark, sf_dir):
    d = inputs.decisions(spark, sf_dir)
    starts = [F.unix_millis(analytics.range_start(r, F.col("ts"))).alias(a) for r, a in
              (("today", "today"), ("7d", "d7"), ("30d", "d30"), ("odd", "other"))]
    return d.select("event_id", *starts)


@query
def decision_totals(spark, sf_dir):
    return analytics.totals(_ranged(spark, sf_dir, "30d", "gemini"))


@query
def decision_totals_blocked(spark, sf_dir):
    return analytics.totals(_ranged(spark, sf_dir, "7d", None, "blocked"))


@query
def volume_cards(spark, sf_dir):
    return analytics.volume_cards(inputs.decisions(spark, sf_dir), now())


@query
def decision_series(spark, sf_dir):
    return analytics.time_series(_ranged(spark, sf_dir, "30d"), "30d")


@query
def decision_series_today(spark, sf_dir):
    return analytics.time_series(_ranged(spark, sf_dir, "today"), "today")


@query
def pii_breakdown(spark, sf_dir):
    return analytics.pii_breakdown(_ranged(spark, sf_dir, "30d"))


@query
def per_surface(spark, sf_dir):
    out = analytics.per_surface(_ranged(spark, sf_dir, "7d"))
    return out.withColumn("last_seen", F.unix_millis("last_seen"))


@query
def recent_events(spark, sf_dir):
    out = analytics.query_events(_ranged(spark, sf_dir, "30d", None, "redacted"), 200)
    return out.select("event_id", F.unix_millis("ts").alias("ts"), "surface", "decision")


def audit_rows(spark, sf_dir):
    p = inputs.config_patches(spark, sf_dir)
    return p.select(
        F.col("seq").alias("audit_id"),
        "ts",
        "admin",
        F.when(F.col("seq") % 3 == 0, "rules.update").otherwise("surface_config.update").alias("action"),
        F.col("surface").alias("target"),
    )


@query
def audit_view(spark, sf_dir):
    out = analytics.query_audit(
        audit_rows(spark, sf_dir), "admin3", "surface_config.update",
        F.timestamp_seconds(F.lit(1704499200)), F.timestamp_seconds(F.lit(1705708800)), 50,
    )
    return out.select("audit_id", "target")


@query
def recent_traffic(spark, sf_dir):
    d = inputs.decisions(spark, sf_dir)
    log = d.select(F.col("event_id").alias("id"), "ts", (F.size("pii_types") > 0).alias("pii_detected"))
    return analytics.recent(log, 40, only_pii=True).select("id")


@query
def current_config(spark, sf_dir):
    catalog = analytics.surface_catalog(spark)
    out = analytics.surface_config(inputs.config_patches(spark, sf_dir), catalog)
    return out.select(
        "surface", "enabled", "mode", "fail_mode", "updated_by", F.unix_millis("updated_at").alias("updated_at")
    )


@query
def config_upserts(spark, sf_dir):
    history = inputs.config_patches(spark, sf_dir)
    current = analytics.surface_config(history, analytics.surface_catalog(spark))
    last = history.groupBy("surface").agg(F.max_by(F.struct("*"), "seq").alias("r")).select("r.*")
    patches = last.withColumn("mode", F.lit("block")).where(F.col("surface") != "grok")
    settings, audit = analytics.apply_config_patch(current, patches)
    changes = audit.select(
        F.col("target").alias("surface"), F.get_json_object("before_value", "$.mode").alias("before_mode"),
        F.get_json_object("after_value", "$.mode").alias("after_mode"), "admin",
    )
    return settings.join(changes, "surface", "left").select(
        "surface", "enabled", "mode", "updated_by", "before_mode", "after_mode", "admin"
    )


@query
def refused_modes(spark, sf_dir):
    out = analytics.validate_modes(inputs.config_patches(spark, sf_dir))
    return out.select("seq", "surface", "mode", "error")


@query
def config_version(spark, sf_dir):
    return analytics.config_version(inputs.config_patches(spark, sf_dir))


@query
def latency_stats(spark, sf_dir):
    return analytics.latency_stats(inputs.decisions(spark, sf_dir), 1_000_000)


@query
def rate_limited_users(spark, sf_dir):
    e = inputs.load(spark, sf_dir, "events")
    attempts = e.select(F.col("event_id").alias("attempt_id"), F.col("user_id").alias("key"), "ts")
    # Two attempts in three days stand for five in a minute, as the given users come days apart.
    out = analytics.allowed_attempts(attempts, 2, 72 * 3_600_000)
    return out.select("attempt_id", "key", "admitted")


@query
def security_log(spark, sf_dir):
    flagged = guard_queries.flagged(spark, sf_dir).select(
        F.lit("cursor-hook").alias("surface"), F.col("analysis.verdict").alias("verdict"),
        F.col("prompt").alias("raw_prompt"), "guidance",
    )
    denied = commands.command_log(inputs.commands(spark, sf_dir), "command").select(F.lit("claude-code").alias("surface"), "permission", F.col("category").alias("command_category"), "command")
    found = codescan.finding_audit(guard_queries._findings(spark, sf_dir), ["conv_id", "file_path"]).select(
        F.lit("claude-code").alias("surface"), "conv_id", "file_path", "n_findings"
    )
    unread = guard_queries._model_findings(spark, sf_dir).where(F.col("f").isNull()).select(
        F.lit("cursor").alias("surface"), "conv_id", "file_path"
    )
    log = analytics.security_rows(flagged, denied, found, unread)
    return log.groupBy("kind", "surface", "verdict", "permission", "command_category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_findings").cast("bigint").alias("n_findings")
    )


@query
def inspector_stats(spark, sf_dir):
    d = inputs.decisions(spark, sf_dir)
    return analytics.inspector_stats(d.select((F.size("pii_types") > 0).alias("pii_detected")))


@query
def surface_health(spark, sf_dir):
    return analytics.surface_health(analytics.per_surface(_ranged(spark, sf_dir, "7d")), now())


@query
def series_pivot(spark, sf_dir):
    return analytics.series_pivot(decision_series(spark, sf_dir))


@query
def top_rules(spark, sf_dir):
    counts = QUERIES["pii_breakdown"](spark, sf_dir)
    return analytics.top_n_breakdown(counts, "type", 14)


@query
def top_risks(spark, sf_dir):
    counts = guard_queries.QUERIES["risk_summary"](spark, sf_dir).where(F.startswith("metric", F.lit("category:")))
    return analytics.top_n_breakdown(counts, "metric", 4)


# --- sources and sinks ------------------------------------------------------------------------------


@query
def read_texts(spark, sf_dir):
    docs = readers.read_texts(spark, f"{sf_dir}/documents.parquet")
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars")
    )


@query
def read_transcripts(spark, sf_dir):
    """Transcripts written as text files, one per conversation, and read back with their line order."""
    lines = inputs.transcript_lines(spark, sf_dir)
    path = shared_dir(spark, "transcripts")
    writers.write_text_files(lines, "path", "value", path, order="pos")
    back = readers.read_transcripts(spark, f"{path}/*/")
    conv = F.regexp_extract("path", r"path=(\d+)\.txt\z", 1).cast("bigint")
    text = payload.string_field(payload.parsed(F.col("value")), "$.message.content[0].text")
    return back.select(conv.alias("conv_id"), "pos", F.length(text).alias("n_chars"))


@query
def read_files(spark, sf_dir):
    """Pages written as files, one per page, and read back as files."""
    path = shared_dir(spark, "pages")
    pages = inputs.load(spark, sf_dir, "pages").select("page_id", F.col("html").alias("value"))
    writers.write_text_files(pages, "page_id", "value", path)
    back = readers.read_files(spark, path)
    page = F.regexp_extract("file_id", r"page_id=(\d+)\.txt\z", 1).cast("bigint")
    return back.select(
        page.alias("page_id"), "size", (F.octet_length("content") == F.col("size")).alias("complete")
    )


@query
def appended_decisions(spark, sf_dir):
    """Raw events appended, then read back by day range."""
    path = shared_dir(spark, "decisions")
    writers.append_decisions(traffic_queries.raw_events(spark, sf_dir), path, now())
    since = F.timestamp_seconds(F.lit(1706054400))
    back = writers.read_decisions(spark, path, since)
    return back.groupBy("surface", "decision").agg(F.count(F.lit(1)).alias("n"))


@query
def event_csv_lines(spark, sf_dir):
    rows = writers.events_for_csv(
        inputs.decisions(spark, sf_dir).withColumn(
            "rule_matched", F.when(F.size("pii_types") > 0, F.array_join("pii_types", ","))
        )
    )
    return rows.select("id", writers.csv_line(writers.EVENT_COLUMNS).alias("line"))


@query
def event_csv_files(spark, sf_dir):
    path = shared_dir(spark, "csv")
    events = inputs.decisions(spark, sf_dir).withColumn(
        "rule_matched", F.when(F.size("pii_types") > 0, F.array_join("pii_types", ","))
    )
    writers.write_events_csv(events, path)
    back = spark.read.csv(path, header=True, quote='"', escape='"')
    return back.groupBy("surface", "pii_types").agg(F.count(F.lit(1)).alias("n"))


@query
def audit_log_files(spark, sf_dir):
    path = shared_dir(spark, "audit")
    rows = audit_rows(spark, sf_dir).drop("audit_id").withColumns(
        {"before_value": F.lit(None).cast("string"), "after_value": F.to_json(F.struct("target"))}
    )
    writers.append_audit(rows, path)
    back = writers.read_audit(spark, path, admin="admin1")
    return back.groupBy("action", "target").agg(F.count(F.lit(1)).alias("n"))


@query
def finding_files(spark, sf_dir):
    path = shared_dir(spark, "findings")
    writers.write_findings(guard_queries._findings(spark, sf_dir), ["conv_id", "file_path"], path)
    back = spark.read.parquet(path)
    return back.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_findings").alias("n_findings")
    )


# --- streams ----------------------------------------------------------------------------------------


@query
def parsed_sse(spark, sf_dir):
    x = inputs.exchanges(spark, sf_dir).where("streaming").select("id", "provider", F.col("response").alias("body"))
    found = events.parse_sse(x, ["id", "provider"])
    v = payload.parsed(F.col("data"))
    return found.select(
        "id", "at", "event",
        events.text_delta(F.col("provider"), v).alias("delta"),
        events.is_terminal(F.col("provider"), F.col("data"), v).alias("terminal"),
        events.is_block_stop(F.col("provider"), v).alias("block_stop"),
    )


def _per_document(rows):
    """Texts (stream_id, place, text) joined per stream, with the matches added up."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("place", "text"))))
    return rows.groupBy(F.col("stream_id").cast("bigint").alias("doc_id")).agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"),
        counts_text(payload.sum_counts(F.collect_list("matched"))).alias("matched"),
    )


@query
def stream_redact_batch(spark, sf_dir):
    out = streaming.redact_stream_batch(inputs.stream_chunks(spark, sf_dir))
    return _per_document(out.select("stream_id", F.col("seq").alias("place"), F.col("chunk").alias("text"), "matched"))


def _joined_deltas(redacted):
    """Text that redacted event streams show, with the matches added up."""
    found = events.parse_sse(redacted.withColumnRenamed("chunk", "body"), ["stream_id", "seq", "matched"])
    delta = events.text_delta(F.lit("anthropic"), payload.parsed(F.col("data")))
    # A match begins in an event of its chunk, so the first one tells all of the chunk, and nothing is read twice.
    counts = F.when((F.col("at") == 0) & (F.size("matched") > 0), F.col("matched"))
    return _per_document(found.select("stream_id", F.struct("seq", "at").alias("place"), delta.alias("text"), counts.alias("matched")))


# The held-back tail must cover the longest sample, or a long match shows its head before it is complete.
HOLDBACK = 256


def _odd_chunks(spark, sf_dir):
    """Event streams, some numbered from 1, some without an end mark."""
    doc = F.col("stream_id").cast("bigint")
    chunks = inputs.event_chunks(spark, sf_dir).where(F.col("chunk").isNotNull() | (doc % 7 != 3))
    return chunks.withColumn("seq", F.col("seq") + (doc % 5 == 1).cast("bigint"))


@query
def stream_redact_sorted(spark, sf_dir):
    return _joined_deltas(redaction.redact_chunks(_odd_chunks(spark, sf_dir)))


def _with_state_store(spark, run):
    """Streaming state needs the RocksDB provider; the session's own setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_STORE[key])
    try:
        return run()
    finally:
        spark.conf.set(key, before)


@query
def stream_redact(spark, sf_dir):
    """The event streams as files, redacted batch by batch, then joined per stream."""
    source, out = shared_dir(spark, "chunks"), shared_dir(spark, "redacted")
    packed(_odd_chunks(spark, sf_dir), source)
    chunks = readers.read_chunks(spark, source, stream=True)
    redaction.run_redaction(chunks, out, shared_dir(spark, "waiting"), holdback=HOLDBACK, close=True)
    return _joined_deltas(spark.read.schema(redaction.REDACTED).parquet(f"{out}/batch=*"))


@query
def reframed_stream(spark, sf_dir):
    frames = streaming.reframe_stream(inputs.event_chunks(spark, sf_dir), "m1", 1700000000, "reply-0")
    found = events.parse_sse(
        frames.select("stream_id", "seq", F.col("chunk").alias("body")), ["stream_id", "seq"]
    )
    v = payload.parsed(F.col("data"))
    rows = found.select(
        "stream_id", "seq", "at", F.col("data") == "[DONE]",
        payload.string_field(v, "$.choices[0].delta.role").alias("role"),
        payload.string_field(v, "$.choices[0].delta.content").alias("content"),
        payload.string_field(v, "$.choices[0].finish_reason").alias("finish"),
    ).toDF("stream_id", "seq", "at", "done", "role", "content", "finish")
    ordered = F.array_sort(
        F.collect_list(F.when(F.col("content").isNotNull(), F.struct("seq", "at", "content")))
    )
    return rows.groupBy(F.col("stream_id").cast("bigint").alias("doc_id")).agg(
        F.count_if("done").alias("n_done"),
        F.count("role").alias("n_start"),
        F.max("finish").alias("finish"),
        F.array_join(F.transform(ordered, lambda x: x["content"]), "").alias("text"),
    )


@query
def dedupe_turns_stream(spark, sf_dir):
    """Every message as a turn of its own, delivered twice and kept once."""
    c = inputs.load(spark, sf_dir, "conversations")
    reply = F.col("role") == "assistant"
    t = c.select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.when(reply, "").otherwise(F.col("text")).alias("prompt"),
        F.when(reply, F.col("text")).otherwise("").alias("response"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("turn")).alias("ts"),
    )
    source, out = shared_dir(spark, "turns"), shared_dir(spark, "fresh")
    t.unionByName(t).write.parquet(source)
    stream = spark.readStream.schema(t.schema).parquet(source)
    fresh = streaming.dedupe_turns_stream(stream)
    streaming.bounded_run(fresh, out, shared_dir(spark, "state"))
    back = spark.read.parquet(out)
    return back.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn_hash")


@query
def pending_findings_stream(spark, sf_dir):
    found = guard_queries._findings(spark, sf_dir).select(
        F.col("file_path").alias("conv_id"), F.col("line").cast("bigint").alias("seq"),
        F.lit(False).alias("turn_ended"), "category", "message", "line",
    )
    found = materialized(found, "findings")
    ends = inputs.code_files(spark, sf_dir).select(
        F.col("file_path").alias("conv_id"), F.lit(1 << 40).cast("bigint").alias("seq"),
        F.lit(True).alias("turn_ended"), F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("message"), F.lit(None).cast("int").alias("line"),
    )
    both = found.unionByName(found).unionByName(ends)
    source, out = shared_dir(spark, "found"), shared_dir(spark, "pending")
    both.write.parquet(source)
    stream = spark.readStream.schema(both.schema).parquet(source)
    pending = streaming.pending_findings_stream(stream)
    _with_state_store(spark, lambda: streaming.bounded_run(pending, out, shared_dir(spark, "state")))
    return spark.read.schema(streaming.PENDING).parquet(out).select(F.col("conv_id").alias("file_path"), "n")


@query
def decisions_stream(spark, sf_dir):
    t = traffic_queries.traffic_rows(spark, sf_dir)
    source, out = shared_dir(spark, "traffic"), shared_dir(spark, "events")
    t.write.parquet(source)
    stream = spark.readStream.schema(t.schema).parquet(source)
    streaming.bounded_run(streaming.decisions_stream(stream), out, shared_dir(spark, "state"))
    back = spark.read.parquet(out)
    return back.groupBy("surface", "direction", "decision").agg(F.count(F.lit(1)).alias("n"))


@query
def series_stream(spark, sf_dir):
    """Hourly counts as the stream leaves them, the hours still open included."""
    d = inputs.decisions(spark, sf_dir)
    source, out = shared_dir(spark, "decided"), shared_dir(spark, "series")
    d.write.parquet(source)
    stream = spark.readStream.schema(d.schema).parquet(source)
    last = streaming.latest_result(streaming.series_stream(stream), out, shared_dir(spark, "state"))
    return spark.read.parquet(last)
