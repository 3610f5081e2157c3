"""Turns from transcripts, audit of what the gate never saw, and pairing of replies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.fixed import traffic as traffic_values
from guardlake.fixed import turns as fixed
from guardlake.functions import payload, spans, transcripts
from guardlake.functions.expr import js_trim
from guardlake.functions.text import short_hash
from guardlake.operators.barrier import sealed
from guardlake.operators.sequence import BLOCK, running_sums
from guardlake.rules import RuleSet
from guardlake.session import materialized


def parse_lines(lines: DataFrame) -> DataFrame:
    """Transcript lines (path, pos, value) as kind, typed text, attachments and reply.

    Lines that are no JSON, as a half-written last line would be, and other messages get a null kind.
    """
    work = lines.withColumn("_v", payload.parsed(F.col("value"))).where(
        F.trim("value") != ""
    )
    text = transcripts.message_text(payload.field(F.col("_v"), "$.message.content"))
    work = work.select(
        "path",
        "pos",
        payload.string_field(F.col("_v"), "$.type").alias("type"),
        payload.string_field(F.col("_v"), "$.role").alias("role"),
        text.alias("_text"),
    )
    is_user = F.col("role") == "user"
    kind = (
        F.when(F.col("type") == fixed.TURN_END, "end")
        .when(F.col("_text") == "", None)
        .when(is_user, "user")
        .when(F.col("role") == "assistant", "assistant")
    )
    return work.withColumn("kind", kind).select(
        "path",
        "pos",
        "kind",
        F.when(F.col("kind") == "user", transcripts.typed_message(F.col("_text"))).alias("typed"),
        F.when(F.col("kind") == "user", transcripts.attachments(F.col("_text"))).alias("attached"),
        F.when(F.col("kind") == "assistant", F.col("_text")).alias("reply"),
    )


def prompt_hash(text: Column) -> Column:
    return short_hash(js_trim(text))


def flag_unchecked(messages: DataFrame, approved: DataFrame) -> DataFrame:
    """Mark typed messages whose hash is not in the ledger (``hash``). An empty ledger marks nothing."""
    ledger = approved.select(F.col("hash").alias("_hash"), F.lit(True).alias("_known")).distinct()
    any_approved = (approved.agg(F.count(F.lit(1)) > 0)).scalar()
    hashed = messages.withColumn(
        "_hash", F.when(F.coalesce("typed", F.lit("")) != "", prompt_hash(F.col("typed")))
    )
    # Lines without a typed message have nothing to look up and are not sent to one place for it.
    looked_up = hashed.where(F.col("_hash").isNotNull()).join(ledger, "_hash", "left")
    unseen = F.col("_known").isNull() & any_approved
    others = hashed.where(F.col("_hash").isNull()).withColumn("unchecked", F.lit(False))
    return looked_up.withColumn("unchecked", unseen).drop("_known").unionByName(others).drop("_hash")


def build_turns(
    lines: DataFrame, approved: DataFrame | None = None, cap: int | None = None
) -> DataFrame:
    """Completed turns: path, turn, prompt, response, scan_extra, unchecked.

    The messages up to each end marker form a turn; an unfinished tail is dropped. With ``cap`` a side is cut
    at so many characters. Texts are joined per block of lines first and per turn then, and at both levels only
    what begins before the cut travels on.
    """
    messages = parse_lines(lines)
    if approved is not None:
        messages = flag_unchecked(messages, approved)
    else:
        messages = messages.withColumn("unchecked", F.lit(False))
    ends = F.when(F.col("kind") == "end", 1).otherwise(0)
    numbered = running_sums(messages, ["path"], "pos", {"turn": ends}, totals_of=_end_markers(lines))
    # Below the window this filter would have every line parsed twice.
    numbered = numbered.where(F.col("kind").isNotNull())
    sides = {
        "typed": fixed.TURN_SEPARATOR,
        "reply": "",
        "attached": fixed.TURN_SEPARATOR,
    }
    blocks = _joined(
        numbered.withColumn("block", F.floor(F.col("pos") / BLOCK)).withColumn("ended", F.col("kind") == "end"),
        ["path", "turn", "block"], "pos", sides, cap,
    )
    whole = _joined(blocks, ["path", "turn"], "block", sides, cap)
    return whole.where("ended").select(
        "path",
        "turn",
        F.col("typed").alias("prompt"),
        F.col("reply").alias("response"),
        F.col("attached").alias("scan_extra"),
        "unchecked",
    )


def _end_markers(lines: DataFrame) -> DataFrame:
    """1 for end markers, 0 for other lines; only lines that hold the marker's text are parsed."""
    is_end = payload.string_field(payload.parsed(F.col("value")), "$.type") == fixed.TURN_END
    named = F.contains("value", F.lit(fixed.TURN_END))
    turn = F.when(named, F.coalesce(is_end, F.lit(False)).cast("int")).otherwise(0)
    return lines.select("path", "pos", turn.alias("turn"))


def _joined(
    rows: DataFrame, keys: list[str], order: str, sides: dict[str, str], cap: int | None
) -> DataFrame:
    """Texts of each side joined in order, and cut if asked for; window and grouping share one shuffle."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def filled(col: str) -> Column:
        return F.coalesce(F.col(col), F.lit("")) != ""

    def start(col: str, separator: str) -> Column:
        size = F.when(filled(col), F.length(col) + len(separator)).otherwise(0)
        return F.coalesce(F.sum(size).over(before), F.lit(0))

    def texts(col: str, separator: str) -> Column:
        # The separator before a text may still fall into the cut.
        wanted = filled(col)
        if cap is not None:
            wanted &= F.col(f"_{col}_at") < cap + len(separator)
        listed = F.collect_list(F.when(wanted, F.struct(order, F.col(col).alias("text"))))
        joined = F.array_join(F.transform(F.array_sort(listed), lambda t: t["text"]), separator)
        return (joined if cap is None else F.substring(joined, 1, cap)).alias(col)

    placed = rows if cap is None else rows.withColumns({f"_{col}_at": start(col, sep) for col, sep in sides.items()})
    return placed.groupBy(*keys).agg(
        F.bool_or("ended").alias("ended"),
        F.coalesce(F.bool_or("unchecked"), F.lit(False)).alias("unchecked"),
        *[texts(col, sep) for col, sep in sides.items()],
    )


def pending_messages(lines: DataFrame) -> DataFrame:
    """User queries after the last end marker: path, pos, nth, text."""
    parsed = payload.parsed(F.col("value"))
    rows = lines.select("path", "pos", parsed.alias("_v")).select(
        "path",
        "pos",
        (payload.string_field(F.col("_v"), "$.role") == "user").alias("_user"),
        transcripts.message_text(payload.field(F.col("_v"), "$.message.content")).alias("_text"),
    )
    queries = F.when(F.col("_user"), transcripts.user_queries(F.col("_text")))
    spoken = rows.select("path", "pos", F.posexplode_outer(queries).alias("nth", "text")).where(
        F.col("text").isNotNull()
    )
    last = _end_markers(lines).groupBy("path").agg(
        F.max(F.when(F.col("turn") == 1, F.col("pos"))).alias("_last")
    )
    return spoken.join(last, "path", "left").where(
        F.col("_last").isNull() | (F.col("pos") > F.col("_last"))
    ).drop("_last")


def turn_hash(prompt: Column, response: Column) -> Column:
    return short_hash(F.concat(prompt, F.lit("\x00"), response))


def new_turns(turns: DataFrame, logged: DataFrame) -> DataFrame:
    """Turns with content that were not logged before (``path``, ``turn_hash``), each once."""
    hashed = turns.withColumn("turn_hash", turn_hash(F.col("prompt"), F.col("response")))
    filled = (
        (js_trim(F.col("prompt")) != "")
        | (js_trim(F.col("response")) != "")
        | (js_trim(F.col("scan_extra")) != "")
    )
    fresh = hashed.join(logged.select("path", "turn_hash"), ["path", "turn_hash"], "left_anti")
    # Of equal turns the first one is logged. Its row is picked by aggregation, which combines early.
    others = [c for c in hashed.columns if c not in ("path", "turn_hash")]
    first = fresh.groupBy("path", "turn_hash").agg(
        F.min_by(F.struct(*others), "turn").alias("_row")
    )
    return first.select("path", "turn_hash", "_row.*").where(filled)


def kept_hashes(turns: DataFrame, logged: DataFrame, keep: int | None = None) -> DataFrame:
    """Ledger after logging: the hashes per transcript, numbered from the newest; the last ``keep`` if given.

    ``logged`` carries ``nth``, the place of each hash.
    """
    fresh = turns.select(
        "path", turn_hash(F.col("prompt"), F.col("response")).alias("turn_hash"), "turn"
    )
    old = logged.select("path", "turn_hash", F.lit(0).alias("age"), F.col("nth").alias("at"))
    new = fresh.select("path", "turn_hash", F.lit(1).alias("age"), F.col("turn").alias("at"))
    first = old.unionByName(new).groupBy("path", "turn_hash").agg(
        F.min(F.struct("age", "at")).alias("place")
    )
    newest = Window.partitionBy("path").orderBy(F.col("place").desc())
    ledger = first.select("path", "turn_hash", F.row_number().over(newest).alias("back"))
    return ledger if keep is None else ledger.where(F.col("back") <= keep)


def log_turns(turns: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Redacted turn log. Attachments are counted, never stored, and mark the turn unchecked."""
    rules = rules or RuleSet()

    def scrub(col: str):
        return spans.redacted(
            F.coalesce(F.col(col), F.lit("")), rules.active, "inbound", rules.allow_patterns
        )

    work = turns.withColumns(
        {"_p": scrub("prompt"), "_r": scrub("response"), "_x": scrub("scan_extra")["matched"]}
    )
    inbound = spans.merge_counts(F.col("_p.matched"), F.col("_x"))
    leaked = spans.has_matches(F.col("_x"))
    kept = [c for c in turns.columns if c not in ("prompt", "response", "scan_extra", "unchecked")]
    return work.select(
        *kept,
        F.col("_p.text").alias("prompt"),
        F.col("_r.text").alias("response"),
        F.struct(inbound.alias("inbound"), F.col("_r.matched").alias("outbound")).alias("matched"),
        (spans.has_matches(inbound) | spans.has_matches(F.col("_r.matched"))).alias("pii_detected"),
        (F.coalesce("unchecked", F.lit(False)) | leaked).alias("unchecked"),
        (js_trim(F.coalesce("scan_extra", F.lit(""))) != "").alias("has_attachment"),
    )


def confirmed_leaks(logged: DataFrame) -> DataFrame:
    """Turns with PII that took a path no gate could see."""
    return sealed(logged).where((F.col("unchecked") | F.col("has_attachment")) & F.col("pii_detected"))


# --- replies onto flagged prompts -------------------------------------------------------------------


def _islands(intervals: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Number the groups of overlapping closed intervals per key: keys..., start, island.

    A group begins where no interval is open, which running sums tell without collecting a key.
    """
    edges = intervals.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(low).alias("start"), F.lit(1).alias("step")),
                F.struct(F.col(high).alias("start"), F.lit(-1).alias("step")),
            )
        ).alias("_e"),
    ).select(*keys, "_e.*")
    points = edges.groupBy(*keys, "start").agg(F.sum("step").alias("step"))
    opened = running_sums(points, keys, "start", {"open": F.col("step")})
    begins = (F.col("open") == 0).cast("int")
    counted = running_sums(opened, keys, "start", {"earlier": begins})
    return counted.select(*keys, "start", (F.col("earlier") + begins).alias("island"))


# Characters of a run by which prompts are looked up in turns.
GRAM = 8


def attach_responses(flags: DataFrame, turns: DataFrame, ring: int = traffic_values.SECURITY_VIEW_ROWS):
    """Give each turn's reply to the newest open flag of its surface that the turn contains.

    ``flags``: log_id, surface, seq, raw_prompt, where ``seq`` counts the rows of one log. ``turns``:
    log_id, surface, turn_id, after_seq, prompt, response, where ``after_seq`` is the number of log rows
    when the turn came in. Only the last ``ring`` rows are open to a turn, as the log holds no more.

    Texts meet by an inverted index: every prompt stands under the one of its runs of ``GRAM`` characters that the
    fewest turns hold (a shorter prompt is its own run), and a turn is compared with the prompts that stand under its
    runs. Equal prompts are one. Only then do the flags of a prompt meet its turns, by blocks of ``ring`` rows. What is
    left is one small row per turn that fits any flag; these are cut into stretches that share no flag, and each stretch
    is settled in order.

    Every table that grows with the input is joined by sorting: runs compress so well that Spark would take them for
    small and send them through the driver. What several steps read is written once.
    """
    keys = ["log_id", "surface"]

    def sorted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        return left.hint("merge").join(right.hint("merge"), on, how)
    named = (
        flags.select(*keys, "seq", js_trim(F.coalesce("raw_prompt", F.lit(""))).alias("_needle"))
        .where(F.col("_needle") != "")
        .withColumn("_prompt", F.sha2("_needle", 256))
    )
    asked = turns.select(*keys, "turn_id", "after_seq", js_trim(F.coalesce("prompt", F.lit(""))).alias("_hay")).where(
        (F.col("_hay") != "") & (F.col("after_seq") > 0)
    )
    needles = materialized(named.select(*keys, "_prompt", "_needle").dropDuplicates([*keys, "_prompt"]), "needles")
    # At most GRAM numbers.
    sizes = sorted(r[0] for r in needles.select(F.least(F.length("_needle"), F.lit(GRAM))).distinct().collect())

    def runs_of(text: Column, size: int) -> Column:
        return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))

    own = F.when(F.length("_needle") < GRAM, F.array("_needle")).otherwise(runs_of(F.col("_needle"), GRAM))
    needle_runs = needles.select(*keys, "_prompt", F.explode(own).alias("_run"))
    hay_runs = asked.select(
        *keys, "turn_id", F.explode(F.concat(F.array().cast("array<string>"), *[runs_of(F.col("_hay"), n) for n in sizes])).alias("_run")
    )
    hay_runs = sorted_join(hay_runs, needle_runs.select(*keys, "_run").distinct(), [*keys, "_run"], "left_semi")
    hay_runs = materialized(hay_runs, "runs")
    held = hay_runs.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_n"))
    # A prompt with a run that no turn holds is in no turn.
    counted = sorted_join(needle_runs, held, [*keys, "_run"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rare = counted.groupBy(*keys, "_prompt").agg(F.min(F.struct("_n", "_run")).alias("_r")).where("_r._n > 0")
    pairs = sorted_join(rare.select(*keys, "_prompt", "_r._run"), hay_runs, [*keys, "_run"]).select(*keys, "_prompt", "turn_id")
    fitting = sorted_join(sorted_join(pairs, asked, [*keys, "turn_id"]), needles, [*keys, "_prompt"])
    fitting = fitting.where(F.contains("_hay", "_needle")).select(*keys, "turn_id", "after_seq", "_prompt")
    block = F.floor((F.col("after_seq") - 1) / ring)
    open_flags = named.select(*keys, "_prompt", "seq", F.floor(F.col("seq") / ring).alias("_block"))
    fits = sorted_join(fitting.withColumn("_block", F.explode(F.array(block, block - 1))), open_flags, [*keys, "_prompt", "_block"])
    fits = fits.where((F.col("seq") < F.col("after_seq")) & (F.col("seq") >= F.col("after_seq") - ring))
    candidates = fits.groupBy(*keys, "turn_id", "after_seq").agg(F.sort_array(F.collect_list("seq"), asc=False).alias("_fits"))
    stretches = candidates.withColumns(
        {"_lo": F.element_at("_fits", -1), "_hi": F.get("_fits", F.lit(0))}
    )
    stretches = materialized(stretches, "stretches")
    islands = _islands(stretches, keys, "_lo", "_hi").withColumnRenamed("start", "_lo")
    stretches = materialized(sorted_join(stretches, islands, [*keys, "_lo"]), "islands")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretch, taken = None, set()
        for batch in batches:
            chosen = []
            for row in batch.itertuples(index=False):
                here = (row.log_id, row.surface, row.stretch)
                if here != stretch:
                    stretch, taken = here, set()
                flag = next((s for s in row.fits if s not in taken), None)
                if flag is not None:
                    taken.add(flag)
                chosen.append(flag)
            out = batch[["log_id", "surface", "turn_id"]].copy()
            out["seq"] = pd.array(chosen, dtype="Int64")
            yield out[out["seq"].notna()]

    kinds = {f.name: f.dataType.simpleString() for f in turns.schema.fields}
    schema = f"log_id {kinds['log_id']}, surface string, turn_id {kinds['turn_id']}, seq bigint"
    pairs = (
        stretches.select(
            *keys, "turn_id", "after_seq", F.col("_fits").alias("fits"), F.col("island").alias("stretch")
        )
        .repartition(*keys, "stretch")
        .sortWithinPartitions(*keys, "stretch", "after_seq", "turn_id")
        .mapInPandas(settle, schema)
    )
    replies = sorted_join(pairs, turns.select(*keys, "turn_id", "response"), [*keys, "turn_id"])
    return sorted_join(flags, replies, [*keys, "seq"], "left")


# --- captured replies -------------------------------------------------------------------------------


def pick_reply(candidates: DataFrame) -> DataFrame:
    """Best candidate per turn, the earliest of equals; a turn whose candidates all fail has none.

    Expects turn_id, pos, text, grew, growth_steps, follows_prompt, contains_prompt, interactive,
    interactive_ratio, appeared and visible.
    """
    descriptor = {
        name: F.col(name)
        for name in (
            "grew", "growth_steps", "follows_prompt", "contains_prompt", "interactive",
            "interactive_ratio", "appeared", "visible",
        )
    }
    descriptor["text_len"] = F.length("text")
    descriptor["metadata_like"] = transcripts.looks_like_metadata(F.col("text"))
    descriptor["boilerplate_like"] = transcripts.looks_like_boilerplate(F.col("text"))
    scored = candidates.withColumn("score", transcripts.reply_score(descriptor))
    best = F.max_by(
        F.struct("pos", "score", "text"),
        F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("pos")).alias("early"))),
    )
    return scored.groupBy("turn_id").agg(best.alias("_best")).select(
        "turn_id", F.col("_best.pos").alias("pos"), F.col("_best.score").alias("score"),
        transcripts.strip_reply_label(F.col("_best.text")).alias("reply"),
    )
