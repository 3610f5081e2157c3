"""Queries over the prompt, command and code guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardlake.fixed.code import CODE_CATEGORIES
from guardlake.fixed.commands import COMMAND_CATEGORIES
from guardlake.functions import code as code_fn
from guardlake.functions import commands as command_fn
from guardlake.functions import payload, risk
from guardlake.operators import codescan, prompts
from guardlake.operators import commands as command_ops
from guardlake.plans import inputs, samples
from guardlake.session import materialized

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def prompt_shapes(spark, sf_dir):
    p = F.col("prompt")
    return inputs.prompts(spark, sf_dir).select(
        "conv_id",
        "turn",
        risk.looks_like_code_or_data(p).alias("code_or_data"),
        risk.has_action_verb(p).alias("action_verb"),
        risk.is_factual_question(p).alias("factual"),
        risk.is_trivial(p).alias("trivial"),
    )


@query
def known_injections(spark, sf_dir):
    return inputs.prompts(spark, sf_dir).select(
        "conv_id", "turn", F.array_join(risk.known_injection(F.col("prompt")), ",").alias("categories")
    )


def _replies(spark, sf_dir):
    """One classifier reply per distinct user text, as a model would have answered."""
    users = inputs.prompts(spark, sf_dir)
    return users.withColumn("reply", inputs.pick(samples.VERDICT_REPLIES, F.length("prompt")))


@query
def parsed_verdicts(spark, sf_dir):
    v = _replies(spark, sf_dir).select("conv_id", "turn", risk.parse_verdict(F.col("reply")).alias("v"))
    return v.select(
        "conv_id", "turn", F.col("v").isNotNull().alias("usable"), "v.risk",
        F.array_join("v.categories", ",").alias("categories"), "v.confidence",
    )


@query
def valid_categories(spark, sf_dir):
    e = inputs.load(spark, sf_dir, "events")
    labels = F.array(F.col("event_type"), F.lit("xss"), inputs.pick(["idor", "nope", "xss"], F.col("user_id")))
    return e.select("event_id", F.array_join(risk.valid_categories(labels), ",").alias("categories"))


def _verdict_table(spark, sf_dir):
    replies = _replies(spark, sf_dir)
    key = F.regexp_replace("prompt", r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")
    return replies.select(key.alias("prompt_key"), risk.parse_verdict(F.col("reply")).alias("verdict"))


@query
def attached_verdicts(spark, sf_dir):
    users = inputs.prompts(spark, sf_dir).withColumn(
        "prompt", F.concat(F.lit(" "), "prompt", F.lit("\n"))
    )
    out = prompts.attach_verdicts(users, "prompt", _verdict_table(spark, sf_dir))
    return out.select("conv_id", "turn", "verdict.risk", "verdict.confidence")


def _judged(spark, sf_dir):
    users = inputs.prompts(spark, sf_dir)
    return prompts.attach_verdicts(users, "prompt", _verdict_table(spark, sf_dir))


def _analyzed(spark, sf_dir):
    return prompts.guard_prompts(_judged(spark, sf_dir), "prompt", "verdict")


def flagged(spark, sf_dir):
    return prompts.flagged_prompts(_judged(spark, sf_dir), "prompt", "verdict")


@query
def analyzed_prompts(spark, sf_dir):
    return _analyzed(spark, sf_dir).select(
        "conv_id", "turn", "analysis.verdict", F.array_join("analysis.categories", ",").alias("categories"),
        "analysis.confidence", "analysis.tier", "blocked",
    )


@query
def prompt_triage(spark, sf_dir):
    users = prompts.analyze_prompts(inputs.prompts(spark, sf_dir), "prompt")
    return users.groupBy("analysis.verdict", "analysis.tier").agg(F.count(F.lit(1)).alias("n"))


@query
def guidance_use(spark, sf_dir):
    used = (
        _analyzed(spark, sf_dir)
        .select(F.explode("template_ids").alias("used"))
        .groupBy("used")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    table = prompts.guidance_templates(spark)
    return table.join(used, table["category"] == used["used"], "left").select(
        "category", "action", "text", F.coalesce("n", F.lit(0)).alias("n")
    )


@query
def template_ids(spark, sf_dir):
    return _analyzed(spark, sf_dir).select(
        "conv_id", "turn", F.array_join("template_ids", ",").alias("template_ids"),
        risk.has_block(F.col("analysis.categories")).alias("has_block"),
    )


@query
def guidance_texts(spark, sf_dir):
    return _analyzed(spark, sf_dir).select("conv_id", "turn", "guidance")


@query
def injected_guidance(spark, sf_dir):
    p = _analyzed(spark, sf_dir)
    by = F.col("turn") / 2 + F.col("conv_id")
    provider = inputs.pick(["anthropic", "gemini", "openai"], F.col("conv_id"))
    kind = (F.floor(F.col("conv_id") / 3) % 3).cast("int")
    quoted = payload.json_text(F.col("prompt"))
    system = F.get(
        F.array(
            F.lit('"system":"Be kind.",'), F.lit('"system":[{"type":"text","text":"Old."}],'), F.lit("")
        ),
        kind,
    )
    part = F.get(
        F.array(
            F.lit('"system_instruction":{"parts":[{"text":"Old."}]},'), F.lit('"systemInstruction":{},'),
            F.lit(""),
        ),
        kind,
    )
    first = F.get(
        F.array(
            F.lit('{"role":"system","content":"Old."},'), F.lit('{"role":"system","content":[]},'), F.lit("")
        ),
        kind,
    )
    user = F.concat(F.lit('{"role":"user","content":'), quoted, F.lit("}"))
    body = (
        F.when(provider == "anthropic", F.concat(F.lit("{"), system, F.lit('"messages":['), user, F.lit("]}")))
        .when(
            provider == "gemini",
            F.concat(F.lit("{"), part, F.lit('"contents":[{"parts":[{"text":'), quoted, F.lit("}]}]}")),
        )
        .otherwise(F.concat(F.lit('{"messages":['), first, user, F.lit("]}")))
    )
    out = p.withColumns({"provider": provider, "body": body}).withColumn(
        "new", risk.inject_guidance(F.col("body"), F.col("provider"), F.col("guidance"))
    )
    v = payload.parsed(F.col("new"))
    s = payload.string_field
    added = (
        F.when(
            provider == "anthropic",
            F.coalesce(
                s(v, "$.system"), s(v, "$.system[1].text"), s(v, "$.system[0].text")
            ),
        )
        .when(
            provider == "gemini",
            F.coalesce(
                s(v, "$.systemInstruction.parts[1].text"), s(v, "$.systemInstruction.parts[0].text")
            ),
        )
        .otherwise(F.when(s(v, "$.messages[0].role") == "system", s(v, "$.messages[0].content")))
    )
    return out.select("conv_id", "turn", added.alias("system"), (F.col("new") == F.col("body")).alias("same"))


def _security(spark, sf_dir):
    guard = flagged(spark, sf_dir).select(
        F.lit("prompt-guard").alias("kind"), F.col("analysis.categories").alias("categories"), "guidance"
    )
    denied = command_ops.command_log(inputs.commands(spark, sf_dir), "command").select(F.lit("command-guard").alias("kind"))
    return guard.unionByName(denied, allowMissingColumns=True)


@query
def risk_summary(spark, sf_dir):
    return prompts.risk_summary(_security(spark, sf_dir))


@query
def rule_eval(spark, sf_dir):
    """Residual secrets and PII as a detector of documents labelled as low quality."""
    from guardlake.operators import redaction

    docs = redaction.detect_pii(inputs.load(spark, sf_dir, "documents"), "text").select(
        "doc_id", "pii_detected", "n_chars"
    )
    labels = inputs.load(spark, sf_dir, "labels")
    got = F.when(F.col("n_chars") < 100, None).when(F.col("pii_detected"), "inject").otherwise("allow")
    judged = labels.join(docs, "doc_id").select(
        F.when(F.col("quality") == 0, "inject").otherwise("allow").alias("expected"), got.alias("verdict")
    )
    return prompts.rule_eval(judged, "expected", "verdict")


# --- commands ---------------------------------------------------------------------------------------


def _command_flags(category: str):
    def run(spark, sf_dir):
        return inputs.commands(spark, sf_dir).select(
            "doc_id", command_fn.trips_category(F.col("command"), category).alias("hit")
        )

    return run


for _entry in COMMAND_CATEGORIES:
    QUERIES[f"command_{_entry['category']}"] = _command_flags(_entry["category"])


def _with_unread(c, every, command):
    """Each command whole; one of ``every`` ids also with ``command`` in its place."""
    broken = c.where(F.col("doc_id") % every == 0).withColumns({"form": F.lit("broken"), "command": command})
    return c.withColumn("form", F.lit("whole")).unionByName(broken)


@query
def command_verdicts(spark, sf_dir):
    c = _with_unread(inputs.commands(spark, sf_dir), 19, F.lit(" \n"))
    out = command_ops.classify_commands(c, "command")
    return out.select(
        "doc_id", "form", "permission", "category", "matched_pattern", "user_message", "agent_message"
    )


@query
def guarded_commands(spark, sf_dir):
    c = _with_unread(inputs.commands(spark, sf_dir), 23, F.lit(None).cast("string"))
    log = command_ops.command_log(c, "command")
    return log.select("doc_id", "form", "permission", "category", "user_message")


@query
def command_category_use(spark, sf_dir):
    out = command_ops.classify_commands(inputs.commands(spark, sf_dir), "command")
    used = out.groupBy(F.col("category").alias("used")).agg(F.count(F.lit(1)).alias("n"))
    table = command_ops.command_categories(spark)
    return table.join(used, table["category"] == used["used"], "left").select(
        "place", "category", table["permission"], F.coalesce("n", F.lit(0)).alias("n")
    )


# --- code -------------------------------------------------------------------------------------------


def _code_lines(category: str):
    def run(spark, sf_dir):
        files = inputs.code_files(spark, sf_dir)
        lines = files.select("doc_id", F.posexplode(F.split("content", r"\r?\n", -1)).alias("at", "line"))
        hit = code_fn.trips_code_category(F.col("line"), category)
        return lines.where(hit).select("doc_id", (F.col("at") + 1).alias("line"))

    return run


for _entry in CODE_CATEGORIES:
    QUERIES[f"code_{_entry['category']}"] = _code_lines(_entry["category"])


def _findings(spark, sf_dir):
    return codescan.scan_lines(
        inputs.code_files(spark, sf_dir), "content", ["conv_id", "file_path", "doc_id"]
    )


@query
def code_findings(spark, sf_dir):
    return _findings(spark, sf_dir).select("doc_id", "tier", "category", "message", "line")


@query
def hardcoded_secrets(spark, sf_dir):
    docs = inputs.load(spark, sf_dir, "documents")
    return codescan.scan_lines(docs, "text", ["doc_id"]).where(
        F.col("category") == "hardcoded_secret"
    ).select("doc_id", "line")


def _model_findings(spark, sf_dir):
    files = inputs.code_files(spark, sf_dir)
    reply = inputs.pick(samples.FINDING_REPLIES, F.col("doc_id"))
    parsed = files.withColumn("f", code_fn.parse_findings(reply))
    return parsed


@query
def parsed_findings(spark, sf_dir):
    p = _model_findings(spark, sf_dir).withColumn("usable", F.col("f").isNotNull())
    rows = p.select("doc_id", "usable", F.explode_outer("f").alias("f"))
    return rows.select("doc_id", "usable", "f.tier", "f.category", "f.message", "f.line")


@query
def merged_findings(spark, sf_dir):
    keys = ["conv_id", "file_path"]
    # Used twice, and rare next to the files they come from.
    first = materialized(_findings(spark, sf_dir).select(*keys, "tier", "category", "message", "line"), "findings")
    second = _model_findings(spark, sf_dir).select(*keys, F.explode_outer("f").alias("f")).where(
        F.col("f").isNotNull()
    ).select(*keys, "f.*")
    repeated = first.where(F.col("line") % 2 == 0)
    return codescan.merge_findings(first, second.unionByName(repeated), keys)


def _accumulated(spark, sf_dir):
    return codescan.accumulate_findings(
        _findings(spark, sf_dir).withColumn("seq", F.col("doc_id")), "seq"
    )


@query
def accumulated_findings(spark, sf_dir):
    return _accumulated(spark, sf_dir).select("conv_id", "nth", "category", "message", "line")


@query
def pending_messages_text(spark, sf_dir):
    return codescan.pending_message(_accumulated(spark, sf_dir))


@query
def finding_audit(spark, sf_dir):
    out = codescan.finding_audit(_findings(spark, sf_dir), ["file_path"])
    listed = F.array_join(
        F.transform("findings", lambda f: F.concat(f["line"].cast("string"), F.lit(":"), f["category"])), ","
    )
    return out.select("file_path", "n_findings", listed.alias("findings"))
