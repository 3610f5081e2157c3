"""Queries over detectors, redaction, hooks and files."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from guardlake.fixed.files import OFFICE_MAX_BYTES, TEXT_MAX_BYTES
from guardlake.fixed.pii import PII_PATTERNS
from guardlake.functions import files as file_fn
from guardlake.functions import spans, validators
from guardlake.functions.expr import all_matches
from guardlake.functions.text import redact_url_credentials, residual_pii, snapshot
from guardlake.operators import files as file_ops
from guardlake.operators import redaction
from guardlake.operators.barrier import sealed
from guardlake.plans import inputs, samples
from guardlake.rules import RuleSet
from guardlake.session import shared_dir
from guardlake.sources import readers

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn




def counts_text(counts):
    """A count map as sorted text."""
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(counts)),
            lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
        ),
        ",",
    )


def _detector(rule: str):
    def run(spark, sf_dir):
        only = RuleSet().only(rule)
        return redaction.exploded_spans(inputs.seeded(spark, sf_dir), ["doc_id"], "text", only)

    return run


for _name, _, _ in PII_PATTERNS:
    QUERIES[f"detect_{_name.lower()}"] = _detector(_name)

CUSTOM_RULES = (("EXAMPLE_MAIL", r"[a-z.]+@example\.com", "i"), ("WORD_PAIR", r"\b(?:the|de|und) [a-z]+\b", ""))


ALLOWED = (r"@example\.(com|org)$", r"^9\.18\.")


def custom_rule_set() -> RuleSet:
    rules = RuleSet()
    for name, pattern, flags in reversed(CUSTOM_RULES):
        rules = rules.add(name, pattern, flags)
    return rules


@query
def custom_rule_counts(spark, sf_dir):
    return redaction.counts_by(inputs.seeded(spark, sf_dir), ["source"], "text", custom_rule_set())


def _written(spark, purpose: str, entries: list[dict]) -> str:
    """A folder of JSON files with one entry each, named in the order of the entries."""
    path = shared_dir(spark, purpose)
    for i, entry in enumerate(entries):
        spark.createDataFrame([(json.dumps([entry]),)], "value string").coalesce(1).write.text(f"{path}/{i:03d}")
    return f"{path}/*"


@query
def rule_file_counts(spark, sf_dir):
    """Custom rules out of a folder of rule files."""
    entries = [{"name": n, "pattern": p, "flags": f} for n, p, f in CUSTOM_RULES]
    rules = readers.read_rules(spark, _written(spark, "rules", entries))
    return redaction.counts_by(inputs.seeded(spark, sf_dir), ["source"], "text", rules)


@query
def allowlist_file_counts(spark, sf_dir):
    """Allowlist entries out of a folder of files; the one that is no pattern is skipped."""
    entries = [{"pattern": p} for p in (*ALLOWED, "(")]
    rules = readers.read_allowlist(spark, _written(spark, "allow", entries))
    return redaction.counts_by(inputs.seeded(spark, sf_dir), ["source"], "text", rules)


@query
def allowlist_usage(spark, sf_dir):
    """Every allowlist entry with the number of words that fit it."""
    rules = RuleSet()
    for pattern in ALLOWED:
        rules = rules.add_allow(pattern)
    rules = rules.set_allow_enabled("a2", False)
    docs = inputs.seeded(spark, sf_dir)
    listed = rules.allow_frame(spark)
    hits = docs.select(F.explode(F.split("text", r"\s+")).alias("word")).agg(
        *[F.count_if(F.col("word").rlike(e.pattern)).alias(e.id) for e in rules.allow]
    )
    return listed.join(hits.unpivot([], [e.id for e in rules.allow], "id", "words"), "id").select(
        "id", "pattern", "source", "enabled", "words"
    )


@query
def luhn_cards(spark, sf_dir):
    pattern = next((p, f) for n, p, f in PII_PATTERNS if n == "CREDIT_CARD")
    rows = inputs.seeded(spark, sf_dir).select(
        "doc_id", F.explode(all_matches(F.col("text"), *pattern)).alias("value")
    )
    return rows.withColumn("valid", validators.luhn_valid(F.col("value")))


@query
def verhoeff_numbers(spark, sf_dir):
    orders = inputs.load(spark, sf_dir, "orders")
    number = F.lpad((F.col("o_orderkey") * 7919 + 100000000007).cast("string"), 12, "0")
    rows = orders.select("o_orderkey", number.alias("number"))
    return rows.withColumn("valid", validators.verhoeff_valid(F.col("number")))


@query
def public_ipv4(spark, sf_dir):
    e = inputs.load(spark, sf_dir, "events")
    ip = F.concat_ws(
        ".",
        F.when(F.col("user_id") % 3 == 0, 127).otherwise(F.col("user_id") % 256).cast("string"),
        (F.col("event_id") % 256).cast("string"),
        F.lit("0"),
        (F.col("user_id") % 200).cast("string"),
    )
    rows = e.select("event_id", ip.alias("ip"))
    return rows.withColumn("is_public", validators.is_public_ipv4(F.col("ip")))


@query
def public_ipv6(spark, sf_dir):
    e = inputs.load(spark, sf_dir, "events")
    tail = F.when(F.col("user_id") % 2 == 0, F.hex("user_id")).otherwise("")
    rows = e.select("event_id", F.concat(inputs.pick(samples.IPV6, F.col("event_id")), tail).alias("ip"))
    return rows.withColumn("is_public", validators.is_public_ipv6(F.col("ip")))


@query
def all_spans(spark, sf_dir):
    found = redaction.find_spans(inputs.seeded(spark, sf_dir), "text")
    rows = found.select("doc_id", F.explode_outer("spans").alias("s")).where(F.col("s").isNotNull())
    return rows.select("doc_id", "s.rule", "s.start", "s.end", "s.rank")


@query
def settled_spans(spark, sf_dir):
    return redaction.exploded_spans(inputs.seeded(spark, sf_dir), ["doc_id"], "text")


@query
def redacted_documents(spark, sf_dir):
    docs = inputs.load(spark, sf_dir, "documents").select("doc_id", "text")
    return redaction.redact(docs, "text").select("doc_id", "redacted", counts_text("matched").alias("matched"))


@query
def redacted_outbound(spark, sf_dir):
    out = redaction.redact(inputs.seeded(spark, sf_dir), "text", direction="outbound")
    return out.select("doc_id", "redacted", counts_text("matched").alias("matched"))


@query
def pii_counts_by_source(spark, sf_dir):
    return redaction.counts_by(inputs.load(spark, sf_dir, "documents"), ["source"], "text")


@query
def seeded_counts_by_source(spark, sf_dir):
    return redaction.counts_by(inputs.seeded(spark, sf_dir), ["source"], "text")


@query
def pages_pii(spark, sf_dir):
    pages = inputs.load(spark, sf_dir, "pages").select("page_id", "html")
    return redaction.detect_pii(pages, "html").select(
        "page_id", "pii_detected", counts_text("matched").alias("matched")
    )


@query
def redacted_struct(spark, sf_dir):
    s = inputs.seeded(spark, sf_dir).select(
        "doc_id",
        F.struct(
            F.col("source").alias("source"),
            F.col("doc_id").alias("number"),
            F.array(F.col("text"), F.lit("call 312-555-0186")).alias("notes"),
            F.create_map(F.lit("x@y.org"), F.struct(F.col("text").alias("body"))).alias("by_mail"),
        ).alias("payload"),
    )
    out = redaction.redact_struct(s, "payload")
    return out.select(
        "doc_id",
        F.col("payload.number").alias("number"),
        F.col("payload.notes")[0].alias("note"),
        F.col("payload.notes")[1].alias("phone"),
        F.col("payload.by_mail")["x@y.org"]["body"].alias("body"),
        counts_text("matched").alias("matched"),
    )


@query
def redacted_json(spark, sf_dir):
    s = inputs.seeded(spark, sf_dir)
    whole = F.to_json(
        F.struct(F.col("doc_id").alias("n"), F.struct(F.array("text").alias("list")).alias("a@b.co"))
    )
    # Every third payload is cut short by one bracket and must go the raw way.
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("{broken "), "text")).otherwise(whole)
    out = redaction.redact_json(s.select("doc_id", raw.alias("raw")), "raw")
    text = F.when(F.col("doc_id") % 3 == 0, F.col("redacted")).otherwise(
        F.from_json("redacted", "struct<n:bigint,`a@b.co`:struct<list:array<string>>>")["a@b.co"]["list"][0]
    )
    return out.select("doc_id", text.alias("text"), counts_text("matched").alias("matched"))


@query
def merged_counts(spark, sf_dir):
    docs = inputs.load(spark, sf_dir, "documents").select("doc_id", "text", inputs.seeded_text().alias("seeded"))
    own = redaction.detect_pii(docs, "text").withColumnRenamed("matched", "own").drop("pii_detected")
    both = redaction.detect_pii(own, "seeded")
    return both.select(
        "doc_id", counts_text(spans.merge_counts(F.col("own"), F.col("matched"))).alias("matched")
    )


@query
def allowlisted_counts(spark, sf_dir):
    rules = RuleSet()
    for pattern in ALLOWED:
        rules = rules.add_allow(pattern)
    return redaction.counts_by(inputs.seeded(spark, sf_dir), ["source"], "text", rules)


@query
def allowlist_filter(spark, sf_dir):
    pattern = next((p, f) for n, p, f in PII_PATTERNS if n == "EMAIL")
    rows = inputs.seeded(spark, sf_dir).select(
        "doc_id", all_matches(F.col("text"), *pattern).alias("values")
    )
    kept = redaction.allowlist_filter(rows, "values", [r"@example\.com\z"])
    return kept.select("doc_id", F.array_join("values", ",").alias("kept"))


@query
def rule_usage(spark, sf_dir):
    rules = RuleSet().set_enabled("IPV4", False)
    used = redaction.rule_usage(inputs.seeded(spark, sf_dir), "text", rules)
    return used.select("name", "source", "enabled", "has_validator", "rule_rank", "matches")


@query
def url_credentials(spark, sf_dir):
    pages = inputs.load(spark, sf_dir, "pages")
    base = F.when(F.contains("url", F.lit("?")), F.col("url")).otherwise(F.concat("url", F.lit("?v=1")))
    url = F.concat(base, inputs.pick(samples.URL_TAILS, F.col("page_id")))
    return pages.select("page_id", redact_url_credentials(url).alias("url"))


@query
def snapshots(spark, sf_dir):
    docs = inputs.load(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.length(snapshot(F.col("text"), 500)).alias("cut"),
        F.length(snapshot(F.col("text"), 0)).alias("whole"),
    )


@query
def residual_check(spark, sf_dir):
    s = redaction.redact(inputs.seeded(spark, sf_dir), "text")
    return s.select(
        "doc_id", residual_pii(F.col("text")).alias("before"), residual_pii(F.col("redacted")).alias("after")
    )


@query
def payload_shapes(spark, sf_dir):
    e = inputs.load(spark, sf_dir, "events")
    raw = F.concat(
        F.lit('{"props":'), "props", F.lit(',"kind":"'), "event_type",
        F.lit('","tags":["a",null,true,[]],"id":'), F.col("event_id").cast("string"), F.lit("}"),
    )
    return redaction.payload_shape(e.select("event_id", raw.alias("raw")), "raw", ["event_id"])


def _tool_calls(spark, sf_dir):
    s = inputs.seeded(spark, sf_dir)
    by = F.col("doc_id") % 4
    body = F.to_json(F.struct(F.col("text").alias("out")))
    return s.select(
        "doc_id",
        F.when(by < 2, "cursor:preToolUse:Shell").otherwise("cursor:postToolUse:Read").alias("source"),
        F.when(by == 0, F.col("text")).alias("tool_input"),
        F.when(by == 1, body).alias("params"),
        F.when(by == 2, F.col("text")).alias("result"),
        F.lit(None).cast("string").alias("tool_output"),
    )


@query
def tool_payloads(spark, sf_dir):
    out = redaction.tool_payload_scrub(_tool_calls(spark, sf_dir))

    def shown(col: str):
        inner = F.get_json_object(col, "$.out")
        return F.when(F.col("doc_id") % 4 == 1, inner).otherwise(F.col(col))

    return out.select(
        "doc_id",
        "pii_detected",
        F.coalesce(shown("request"), F.lit("")).alias("request"),
        F.col("response"),
        F.coalesce(counts_text("matched"), F.lit("")).alias("matched"),
    )


def _mention_inputs(spark, sf_dir):
    docs = inputs.load(spark, sf_dir, "documents")
    users = inputs.prompts(spark, sf_dir)
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    files = inputs.seeded(spark, sf_dir).select(path.alias("path"), F.col("text").alias("content"))
    send = F.concat_ws("-", "conv_id", "turn")
    named = F.concat(
        "prompt", F.lit(" see @doc/"), F.col("conv_id").cast("string"), F.lit(", (@doc/"),
        (F.col("conv_id") + F.col("turn") * 7).cast("string"), F.lit(") and @nowhere!"),
    )
    return docs, users.select(send.alias("send_id"), named.alias("prompt")), files


@query
def mentioned_files(spark, sf_dir):
    _, prompts, files = _mention_inputs(spark, sf_dir)
    out = redaction.extract_mentions(prompts, files, "send_id", "prompt").join(files, "path")
    return out.select("send_id", "nth", "path", F.length("content").alias("n_chars"))


@query
def scanned_sends(spark, sf_dir):
    _, prompts, files = _mention_inputs(spark, sf_dir)
    mentions = redaction.extract_mentions(prompts, files, "send_id", "prompt")
    system = inputs.load(spark, sf_dir, "conversations").where(F.col("role") == "system")
    pending = system.select(
        F.format_string("%d-%d", "conv_id", F.col("turn") + 1).alias("send_id"),
        F.lit(0).alias("pos"),
        F.concat(F.lit("mail a@b.org "), "text").alias("text"),
    )
    return redaction.scan_targets(prompts, mentions, files, pending, "send_id")


# --- files ------------------------------------------------------------------------------------------


@query
def file_extensions(spark, sf_dir):
    return inputs.files(spark, sf_dir).select(
        "file_id", file_fn.file_extension(F.col("name")).alias("ext")
    )


@query
def classified_files(spark, sf_dir):
    f = inputs.files(spark, sf_dir)
    big = f.withColumn("size", F.col("size") * F.when(F.col("file_id") % 7 == 0, 5000).otherwise(1))
    return file_ops.classify_files(big, TEXT_MAX_BYTES, OFFICE_MAX_BYTES).select("file_id", "scannable", "kind", "reason")


@query
def upload_decisions(spark, sf_dir):
    f = file_ops.classify_files(inputs.files(spark, sf_dir), TEXT_MAX_BYTES, OFFICE_MAX_BYTES)
    r = redaction.redact(f, "text")
    decision = file_fn.decide_upload(
        F.col("scannable"),
        F.col("reason"),
        F.when(F.col("file_id") % 13 != 0, F.col("text")),
        F.col("file_id") % 17 != 0,
        F.col("redacted"),
        F.size("matched") > 0,
    )
    return r.withColumn("d", decision).select("file_id", "d.action", "d.reason", "d.detail", "d.text")


def _spoilt(packed: bytes, how: int) -> bytes:
    """The archive with damaged data (3) or marked as encrypted (5)."""
    data = bytearray(packed)
    body = data.find(b"word/document.xml") + len(b"word/document.xml")
    if how == 3:
        data[body : body + 4] = b"\xff\xff\xff\xff"
    if how == 5:
        for mark, flags in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
            at = data.find(mark)
            while at >= 0:
                data[at + flags] |= 1
                at = data.find(mark, at + 4)
    return bytes(data)


def _archives(spark, sf_dir, odd: bool = False):
    """Every document as a Word file: one paragraph per line, each line split into two runs.

    With ``odd``, of each eleven one is damaged, one encrypted and one without any text part.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents = []
            for file_id, text in zip(batch["file_id"], batch["text"]):
                how = file_id % 11 if odd else 0
                paragraphs = []
                for line in text.split("\n"):
                    half = len(line) // 2
                    halves = [line[:half], line[half:]]
                    xml = [
                        h.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for h in halves
                    ]
                    runs = "".join(f'<w:r><w:t xml:space="preserve">{x}</w:t></w:r>' for x in xml)
                    paragraphs.append(f"<w:p>{runs}</w:p>")
                body = "<w:document><w:body>" + "<w:p/>".join(paragraphs) + "</w:body></w:document>"
                packed = io.BytesIO()
                with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("[Content_Types].xml", "<Types>a@b.org</Types>")
                    archive.writestr("word/media.xml" if how == 7 else "word/document.xml", body)
                contents.append(_spoilt(packed.getvalue(), how))
            yield pd.DataFrame({"file_id": batch["file_id"], "content": contents})

    docs = inputs.seeded(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "text")
    return docs.mapInPandas(pack, "file_id bigint, content binary")


@query
def office_paragraphs(spark, sf_dir):
    parts = file_ops.office_parts(_archives(spark, sf_dir), ["file_id"])
    texts = file_ops.office_paragraphs(parts, ["file_id"])
    r = redaction.redact(texts, "text")
    return sealed(r).where(F.size("matched") > 0).select(
        "file_id", F.col("redacted").alias("text"), counts_text("matched").alias("matched")
    )


@query
def redacted_files(spark, sf_dir):
    plain = inputs.files(spark, sf_dir).withColumn("content", F.encode("text", "UTF-8"))
    office = _archives(spark, sf_dir, odd=True).select(
        (-F.col("file_id") - 1).alias("file_id"),
        F.lit("letter.docx").alias("name"),
        F.lit("").alias("mime"),
        F.octet_length("content").cast("bigint").alias("size"),
        "content",
    )
    both = plain.select(office.columns).unionByName(office)
    out = file_ops.redact_files(both, None, TEXT_MAX_BYTES, OFFICE_MAX_BYTES)
    return out.select(
        "file_id", "action", "reason", "detail", "text", counts_text("matched").alias("matched")
    )


@query
def endpoint_sites(spark, sf_dir):
    pages = inputs.load(spark, sf_dir, "pages")
    ends = [("com", "example.com", ""), ("fr", "", "/fr/"), ("net", "example.net", "/en/")]
    out = file_ops.match_endpoint(pages.select("page_id", "url"), "url", ends)
    fragments = file_fn.url_holds(F.col("url"), ["/de/", "blog."])
    return out.select("page_id", F.array_join("sites", ",").alias("sites"), fragments.alias("holds"))
