"""Inputs of the operators, derived row by row from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.plans import samples
from guardlake.session import spread

# Tables whose texts are scanned, with the columns that tell their rows apart.
TEXT_TABLES = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"]}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One given table. Its time stamps carry no zone and mean UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table in TEXT_TABLES:
        return spread(df, *TEXT_TABLES[table])
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def pick(items: list, by: Column) -> Column:
    """Element number ``by`` modulo the length of a literal list."""
    return F.get(F.array(*[F.lit(i) for i in items]), (by % len(items)).cast("int"))


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each with one PII sample on a line of its own at the end."""
    return load(spark, sf_dir, "documents").select("doc_id", "source", seeded_text().alias("text"))


def seeded_text() -> Column:
    return F.concat("text", F.lit("\n"), pick(samples.PII, F.col("doc_id")))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages as prompts, some turned into questions or attacks."""
    users = load(spark, sf_dir, "conversations").where(F.col("role") == "user")
    by = F.col("conv_id") + F.col("turn")
    before = pick([b for b, _ in samples.PROMPTS], by)
    after = pick([a for _, a in samples.PROMPTS], by)
    return users.select("conv_id", "turn", F.concat(before, "text", after).alias("prompt"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shell commands, the document text being their trailing comment."""
    command = F.concat(pick(samples.COMMANDS, F.col("doc_id")), F.lit(" "), "text")
    return load(spark, sf_dir, "documents").select("doc_id", command.alias("command"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files: the document, then one line of code, CRLF before every other one."""
    end = pick(["\n", "\r\n"], F.col("doc_id"))
    content = F.concat("text", end, pick(samples.CODE_LINES, F.col("doc_id")))
    return load(spark, sf_dir, "documents").select(
        F.col("source").alias("conv_id"),
        F.format_string("src/f%d.py", "doc_id").alias("file_path"),
        "doc_id",
        content.alias("content"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision events out of the event stream."""
    kind = F.col("event_type")
    third = (F.floor("value") % 3).cast("int")
    types = (
        F.when(third == 1, F.array(F.lit("EMAIL")))
        .when(third == 2, F.array(F.lit("EMAIL"), F.lit("IPV4")))
        .otherwise(F.array().cast("array<string>"))
    )
    decision = F.when(kind == "error", "blocked").when(kind == "purchase", "redacted").otherwise("allowed")
    return load(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        pick(samples.SURFACE_NAMES, F.col("user_id")).alias("surface"),
        F.when(kind == "view", "incoming").otherwise("outgoing").alias("direction"),
        decision.alias("decision"),
        types.alias("pii_types"),
        F.floor(F.col("value") * 10).alias("latency_ms"),
    )


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript lines; every reply is followed by an end marker."""
    content = F.when(
        F.col("role") == "user",
        F.concat(
            F.lit("<timestamp>now</timestamp><user_query>\n"), "text", F.lit("\n</user_query>")
        ),
    ).otherwise(F.col("text"))
    block = F.struct(F.lit("text").alias("type"), content.alias("text"))
    tool = F.struct(F.lit("tool_use").alias("type"), F.lit("skipped").alias("text"))
    line = F.to_json(
        F.struct("role", F.struct(F.array(block, tool).alias("content")).alias("message"))
    )
    ended = F.lit('{"type":"turn_ended"}')
    lines = F.when(F.col("role") == "assistant", F.array(line, ended)).otherwise(F.array(line))
    return load(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("path"), "turn", F.posexplode(lines).alias("_at", "value")
    ).select("path", (F.col("turn") * 2 + F.col("_at")).alias("pos"), "value")


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as request/response pairs of the three providers, streamed ones among them."""
    s = seeded(spark, sf_dir)
    provider = pick(["anthropic", "openai", "gemini"], F.col("doc_id"))
    streaming = (F.floor(F.col("doc_id") / 3) % 2) == 1
    model = pick(samples.MODELS, F.col("doc_id"))
    text = F.col("text")

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    wrapped = F.concat(F.lit("<system-reminder>note</system-reminder>"), text)
    asked = F.to_json(
        F.struct(
            model.alias("model"),
            F.array(
                message("user", wrapped),
                message("assistant", F.lit("ok")),
                message("user", F.lit("<session></session>")),
            ).alias("messages"),
        )
    )
    part = F.array(F.struct(text.alias("text")))
    candidate = F.struct(
        F.array(F.struct(F.struct(part.alias("parts")).alias("content"))).alias("candidates")
    )
    typed = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))

    def choice(inner: Column) -> Column:
        return F.to_json(F.struct(F.array(inner).alias("choices")))

    buffered = (
        F.when(provider == "anthropic", F.to_json(F.struct(typed.alias("content"))))
        .when(
            provider == "openai",
            choice(F.struct(F.struct(text.alias("content")).alias("message"))),
        )
        .otherwise(F.to_json(candidate))
    )
    event = (
        F.when(
            provider == "anthropic",
            F.to_json(
                F.struct(
                    F.lit("content_block_delta").alias("type"), F.struct(text.alias("text")).alias("delta")
                )
            ),
        )
        .when(provider == "openai", choice(F.struct(F.struct(text.alias("content")).alias("delta"))))
        .otherwise(F.to_json(candidate))
    )
    stream = F.concat(F.lit("event: x\ndata: "), event, F.lit("\n\ndata: [DONE]\n\n"))
    return s.select(
        F.col("doc_id").alias("id"),
        F.timestamp_seconds(F.col("doc_id") + 1704067200).alias("ts"),
        provider.alias("provider"),
        model.alias("model"),
        (F.col("doc_id") % 11 == 0).alias("blocked"),
        F.lit("POST").alias("method"),
        F.concat(F.lit("/v1/x?key=s3cret&n="), F.col("doc_id").cast("string")).alias("path"),
        F.lit(200).alias("status"),
        streaming.alias("streaming"),
        (F.col("doc_id") * 3 % 1000).alias("duration_ms"),
        asked.alias("request"),
        F.when(streaming, stream).otherwise(buffered).alias("response"),
    )


def stream_chunks(spark: SparkSession, sf_dir: str, width: int = 40) -> DataFrame:
    """Seeded documents cut into plain chunks, numbered per document."""
    pieces = F.regexp_extract_all("text", F.lit(f"[\\s\\S]{{1,{width}}}"), F.lit(0))
    return seeded(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("stream_id"),
        F.lit(None).cast("string").alias("provider"),
        F.posexplode(pieces).alias("_at", "chunk"),
    ).select("stream_id", "provider", F.col("_at").cast("bigint").alias("seq"), "chunk")


def event_chunks(spark: SparkSession, sf_dir: str, width: int = 40) -> DataFrame:
    """Seeded documents as Anthropic event streams, one delta per piece, with start and stop events.

    An event that holds a null chunk ends the stream.
    """
    pieces = F.regexp_extract_all("text", F.lit(f"[\\s\\S]{{1,{width}}}"), F.lit(0))

    def event(name: str, data: Column) -> Column:
        return F.concat(F.lit(f"event: {name}\ndata: "), data, F.lit("\n\n"))

    def delta(piece: Column) -> Column:
        inner = F.struct(F.lit("text_delta").alias("type"), piece.alias("text"))
        whole = F.struct(F.lit("content_block_delta").alias("type"), inner.alias("delta"))
        return event("content_block_delta", F.to_json(whole))

    head = F.array(event("message_start", F.lit('{"type":"message_start"}')))
    tail = F.array(
        event("content_block_stop", F.lit('{"type":"content_block_stop","index":0}')),
        event("message_delta", F.lit('{"type":"message_delta","delta":{"stop_reason":"max_tokens"}}')),
        event("message_stop", F.lit('{"type":"message_stop"}')),
        F.lit(None).cast("string"),
    )
    chunks = F.concat(head, F.transform(pieces, delta), tail)
    return seeded(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("stream_id"),
        F.lit("anthropic").alias("provider"),
        F.posexplode(chunks).alias("_at", "chunk"),
    ).select("stream_id", "provider", F.col("_at").cast("bigint").alias("seq"), "chunk")


def config_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings changes out of events: a mode and, now and then, a switch."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        "ts",
        pick([*samples.SURFACE_NAMES, "teams"], F.col("user_id")).alias("surface"),
        pick(["redact", "block", "off", "allow", None], F.col("event_id")).alias("mode"),
        pick([True, None, False, None], F.col("event_id")).alias("enabled"),
        F.lit(None).cast("map<string,boolean>").alias("pii_type_toggles"),
        F.lit(None).cast("string").alias("fail_mode"),
        F.format_string("admin%d", F.col("user_id") % 5).alias("admin"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as attached files under varied names and types; office names hold real archives."""
    s = seeded(spark, sf_dir)
    return s.select(
        F.col("doc_id").alias("file_id"),
        pick([n for n, _ in samples.FILE_NAMES], F.col("doc_id")).alias("name"),
        pick([m for _, m in samples.FILE_NAMES], F.col("doc_id")).alias("mime"),
        F.octet_length("text").cast("bigint").alias("size"),
        "text",
    )
