"""Detect and redact sensitive values in DataFrame columns."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.fixed import turns as turn_values
from guardlake.functions import payload, spans, transcripts
from guardlake.functions.expr import any_of, js_trim
from guardlake.functions.text import snapshot
from guardlake.operators.barrier import sealed
from guardlake.rules import RuleSet


def find_spans(df: DataFrame, col: str, rules: RuleSet | None = None, out: str = "spans") -> DataFrame:
    """Every validated, not allowlisted match of every enabled rule, overlaps included."""
    rules = rules or RuleSet()
    return df.withColumn(out, spans.find_spans(F.col(col), rules.active, rules.allow_patterns))


def resolve_overlaps(df: DataFrame, col: str = "spans", out: str = "kept") -> DataFrame:
    return df.withColumn(out, spans.resolve_overlaps(F.col(col)))


def _with_kept(df: DataFrame, col: str, rules: RuleSet | None) -> DataFrame:
    """Add the settled spans as a column of their own, so that later uses share one evaluation."""
    rules = rules or RuleSet()
    found = spans.find_spans(F.col(col), rules.active, rules.allow_patterns)
    return df.withColumn("_kept", spans.resolve_overlaps(found))


def redact(
    df: DataFrame,
    col: str,
    rules: RuleSet | None = None,
    direction: str = "inbound",
    out: str = "redacted",
    counts: str = "matched",
) -> DataFrame:
    """Add the redacted text and the matches per rule."""
    kept = F.col("_kept")
    added = {
        out: spans.render(F.col(col), kept, direction),
        counts: spans.match_counts(kept),
    }
    return _with_kept(df, col, rules).withColumns(added).drop("_kept")


def detect_pii(df: DataFrame, col: str, rules: RuleSet | None = None) -> DataFrame:
    """Add ``matched`` and ``pii_detected``; no text is produced."""
    kept = F.col("_kept")
    added = {"matched": spans.match_counts(kept), "pii_detected": F.size(kept) > 0}
    return _with_kept(df, col, rules).withColumns(added).drop("_kept")


def exploded_spans(df: DataFrame, keep: list[str], col: str, rules: RuleSet | None = None) -> DataFrame:
    """One row per kept span with its value."""
    work = _with_kept(df, col, rules)
    valued = F.transform(
        "_kept",
        lambda s: F.struct(
            s["rule"], s["start"], s["end"],
            F.substring(F.col(col), s["start"] + 1, s["end"] - s["start"]).alias("value"),
        ),
    )
    # The outer form keeps Spark from testing the span list once more below the projection.
    rows = work.select(*keep, F.explode_outer(valued).alias("_span"))
    return rows.where(F.col("_span.rule").isNotNull()).select(*keep, "_span.*")


def counts_by(df: DataFrame, keys: list[str], col: str, rules: RuleSet | None = None) -> DataFrame:
    """Matches per key and rule. Rows combine before the shuffle, so a hot key costs no more."""
    work = _with_kept(df, col, rules)
    names = work.select(
        *keys, F.explode_outer(F.transform("_kept", lambda s: s["rule"])).alias("rule")
    )
    return names.where(F.col("rule").isNotNull()).groupBy(*keys, "rule").agg(
        F.count(F.lit(1)).alias("n")
    )


def allowlist_filter(df: DataFrame, col: str, patterns: list[str], out: str = "values") -> DataFrame:
    """Drop array values that any allowlist pattern (Java dialect) matches."""
    return df.withColumn(
        out, F.filter(F.col(col), lambda v: ~any_of(v.rlike(p) for p in patterns))
    )


def rule_usage(df: DataFrame, col: str, rules: RuleSet | None = None) -> DataFrame:
    """The rule list with the number of matches of each rule in the data."""
    rules = rules or RuleSet()
    used = counts_by(df, [], col, rules)
    listed = rules.rules_frame(df.sparkSession)
    return listed.join(used, listed["name"] == used["rule"], "left").select(
        listed["*"], F.coalesce("n", F.lit(0)).alias("matches")
    )


# --- nested payloads --------------------------------------------------------------------------------


def _walk(value: Column, kind: T.DataType, leaf) -> Column:
    """Replace every string leaf by ``leaf(value)``, keeping the shape."""
    if isinstance(kind, T.StringType):
        return leaf(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _walk(x, kind.elementType, leaf))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _walk(x, kind.valueType, leaf))
    if isinstance(kind, T.StructType):
        fields = [_walk(value[f.name], f.dataType, leaf).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _leaf_counts(value: Column, kind: T.DataType) -> Column | None:
    """Sum of the counts in a walked value, null when the type holds no strings."""
    if isinstance(kind, T.StringType):
        return value["matched"]
    if isinstance(kind, T.ArrayType):
        if _leaf_counts(value, kind.elementType) is None:
            return None
        return payload.sum_counts(F.transform(value, lambda x: _leaf_counts(x, kind.elementType)))
    if isinstance(kind, T.MapType):
        if _leaf_counts(value, kind.valueType) is None:
            return None
        return payload.sum_counts(
            F.transform(F.map_values(value), lambda x: _leaf_counts(x, kind.valueType))
        )
    if isinstance(kind, T.StructType):
        parts = [_leaf_counts(value[f.name], f.dataType) for f in kind.fields]
        parts = [p for p in parts if p is not None]
        return payload.sum_counts(F.array(*parts)) if parts else None
    return None


def _leaf_texts(value: Column, kind: T.DataType) -> Column:
    """Undo ``_walk``: put the redacted text where each string was."""
    if isinstance(kind, T.StringType):
        return value["text"]
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _leaf_texts(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _leaf_texts(x, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [_leaf_texts(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def redact_struct(
    df: DataFrame, col: str, rules: RuleSet | None = None, direction: str = "inbound"
) -> DataFrame:
    """Redact every string inside a struct, array or map column; keys and other types stay."""
    rules = rules or RuleSet()
    kind = df.schema[col].dataType

    def scrub(text: Column) -> Column:
        return spans.redacted(text, rules.active, direction, rules.allow_patterns)

    # Whatever is taken out of the payload later, its strings are scanned once.
    walked = sealed(df.withColumn("_walked", _walk(F.col(col), kind, scrub)))
    counts = _leaf_counts(F.col("_walked"), kind)
    none = F.create_map().cast(spans.COUNTS)
    return (
        walked.withColumn(col, _leaf_texts(F.col("_walked"), kind))
        .withColumn("matched", none if counts is None else F.coalesce(counts, none))
        .drop("_walked")
    )


def redact_json(
    df: DataFrame,
    col: str,
    rules: RuleSet | None = None,
    direction: str = "inbound",
    out: str = "redacted",
    counts: str = "matched",
) -> DataFrame:
    """As ``redact_struct`` on JSON text of any shape; text that is no JSON is scrubbed as it is."""
    rules = rules or RuleSet()
    scrubbed = payload.redacted_json(F.col(col), rules.active, direction, rules.allow_patterns)
    return (
        df.withColumn("_scrubbed", scrubbed)
        .withColumn(out, F.col("_scrubbed.text"))
        .withColumn(counts, F.col("_scrubbed.matched"))
        .drop("_scrubbed")
    )


def _nesting(raw: Column) -> Column:
    """How deep the brackets of a JSON text go, those inside strings aside."""
    bare = F.regexp_replace(raw, r'"(?:[^"\\]++|\\[\s\S])*+"', "")
    brackets = F.split(F.regexp_replace(bare, r"[^\[\]{}]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, bracket: Column) -> Column:
        now = state["now"] + F.when(bracket.isin("[", "{"), 1).when(bracket.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(brackets, start, step, lambda state: state["most"])


def _node(path: Column, value: Column, opened: bool) -> Column:
    return F.struct(path.alias("path"), value.alias("value"), F.lit(opened).alias("opened"))


def payload_shape(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """Key paths, types, string lengths and array sizes of JSON texts, never values.

    The texts are unrolled level by level, as many levels as the deepest one has; that number is all the driver
    learns. Texts that do not parse give no rows; the outermost object has no path and none either.
    """
    levels = df.agg(F.max(_nesting(F.col(col)))).first()[0] or 0
    root = _node(F.lit(""), payload.parsed(F.col(col)), False)
    work = df.select(*keep, root.alias("_n")).where(F.col("_n.value").isNotNull())
    path, value = F.col("_n.path"), F.col("_n.value")
    nodes = "array<struct<path:string,value:variant,opened:boolean>>"
    items = F.transform(
        payload.list_field(value),
        lambda x, i: _node(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), x, False),
    )
    members = F.transform(
        F.map_entries(payload.field(value, "$", "map<string,variant>")),
        lambda e: _node(F.when(path == "", e["key"]).otherwise(F.concat(path, F.lit("."), e["key"])), e["value"], False),
    )
    none = F.array().cast(nodes)
    inner = F.coalesce(items.cast(nodes), members.cast(nodes), none)
    unrolled = F.concat(F.array(_node(path, value, True)), F.when(F.col("_n.opened"), none).otherwise(inner))
    for _ in range(levels):
        work = work.select(*keep, F.explode(unrolled.cast(nodes)).alias("_n"))
    shape = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    kind = (
        F.when(shape == "VOID", "null")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "STRING", "string")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape.startswith("OBJECT"), "object")
        .otherwise("number")
    )
    size = F.when(shape == "STRING", F.length(payload.field(value, "$", "string"))).when(
        shape.startswith("ARRAY"), F.size(payload.list_field(value))
    )
    listed = work.select(*keep, path.alias("path"), kind.alias("kind"), size.cast("int").alias("size"))
    return listed.where((F.col("path") != "") | (F.col("kind") != "object"))


# --- editor hooks -----------------------------------------------------------------------------------


def tool_payload_scrub(
    df: DataFrame, rules: RuleSet | None = None, snapshot_chars: int = 0
) -> DataFrame:
    """Scrub tool inputs and outputs that arrive under one of several field names.

    Expects ``source`` and any of the known field names as string columns. A post-tool payload is what
    the tool returned and goes to the response side; anything else goes to the request side.
    """
    after = F.coalesce(F.col("source").rlike("(?i)postToolUse"), F.lit(False))

    def pick(names: list[str]) -> Column:
        present = [F.col(n) for n in names if n in df.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    picked = F.when(after, pick(turn_values.TOOL_OUTPUT_FIELDS)).otherwise(
        pick(turn_values.TOOL_INPUT_FIELDS)
    )
    work = redact_json(df.withColumn("payload", picked), "payload", rules)
    shown = snapshot(F.coalesce("redacted", F.lit("")), snapshot_chars)
    return work.withColumns(
        {
            "pii_detected": F.coalesce(F.size("matched"), F.lit(0)) > 0,
            "request": F.when(after, "").otherwise(shown),
            "response": F.when(after, shown).otherwise(""),
        }
    )


def extract_mentions(
    prompts: DataFrame, files: DataFrame, id_col: str, prompt_col: str, most: int | None = None
) -> DataFrame:
    """Files named by ``@token`` in a prompt: the distinct ones in order of mention; the first ``most`` if given.

    ``files`` holds ``path`` and ``content``. Unknown tokens name no file and are skipped.
    """
    tokens = prompts.select(
        id_col, F.posexplode_outer(transcripts.mention_tokens(F.col(prompt_col))).alias("at", "path")
    ).where(F.col("path").isNotNull())
    first = tokens.groupBy(id_col, "path").agg(F.min("at").alias("at"))
    known = first.join(files.select("path"), "path", "left_semi")
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("at"))
    numbered = known.select(id_col, place.alias("nth"), "path")
    return numbered if most is None else numbered.where(F.col("nth") <= most)


def scan_targets(
    prompts: DataFrame,
    mentions: DataFrame,
    files: DataFrame,
    pending: DataFrame,
    id_col: str,
    rules: RuleSet | None = None,
) -> DataFrame:
    """Per send: is any part of it sensitive, which part is first, and which rules matched there.

    ``prompts`` (id, prompt), ``mentions`` (id, nth, path) into ``files`` (path, content), and ``pending``
    (id, pos, text) are checked in this order. Binary and blank parts are skipped, and so is a pending copy
    of the prompt. A file is scanned once, however many sends mention it.
    """
    own = prompts.select(
        id_col,
        F.lit(0).alias("part"),
        F.lit(0).cast("bigint").alias("nth"),
        F.lit(turn_values.PROMPT_LABEL).alias("label"),
        F.col("prompt").alias("text"),
    )
    same = js_trim(F.col("prompt")) == F.col("text")
    queued = (
        pending.join(prompts.select(id_col, "prompt"), id_col)
        .where(~F.coalesce(same, F.lit(False)))
        .select(
            id_col, F.lit(2).alias("part"), F.col("pos").cast("bigint").alias("nth"),
            F.lit(turn_values.PENDING_LABEL).alias("label"), "text",
        )
    )
    typed = own.unionByName(queued).where(js_trim(F.col("text")) != "")
    checked = detect_pii(typed, "text", rules).drop("text")
    used = files.join(mentions.select("path").distinct(), "path", "left_semi").where(
        (js_trim(F.col("content")) != "") & ~F.contains("content", F.lit("\x00"))
    )
    scanned = detect_pii(used, "content", rules).select("path", "matched", "pii_detected")
    named = mentions.join(scanned, "path").select(
        id_col, F.lit(1).alias("part"), F.col("nth").cast("bigint"), F.col("path").alias("label"),
        "matched", "pii_detected",
    )
    hit = F.when(
        F.col("pii_detected"),
        F.struct("part", "nth", "label", F.array_sort(F.map_keys("matched")).alias("types")),
    )
    return (
        checked.unionByName(named)
        .groupBy(id_col)
        .agg(F.count(F.lit(1)).alias("targets"), F.min(hit).alias("_hit"))
        .select(
            id_col,
            "targets",
            F.col("_hit").isNotNull().alias("blocked"),
            F.col("_hit.label").alias("label"),
            F.array_join("_hit.types", ", ").alias("types"),
        )
    )
