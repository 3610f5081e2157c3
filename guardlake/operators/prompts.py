"""Prompt guard over tables of prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.fixed import prompts as fixed
from guardlake.functions import risk
from guardlake.functions.expr import js_trim
from guardlake.operators.barrier import sealed


def guidance_templates(spark: SparkSession) -> DataFrame:
    rows = [(i, c, a, t) for i, (c, (a, t)) in enumerate(fixed.GUIDANCE.items())]
    return spark.createDataFrame(rows, "place int, category string, action string, text string")


def attach_verdicts(
    prompts: DataFrame,
    col: str,
    verdicts: DataFrame | None = None,
    scorer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add ``verdict``, the second tier's answer, asked once per distinct trimmed prompt.

    Give a table (``prompt_key``, ``verdict``) or a function of the prompt column, such as a pandas UDF
    returning null on failure. Prompts the first tier settles are not asked and get none. Of several verdicts on
    one prompt a risky one counts before a harmless one, then the more confident one.
    """
    open_one = F.coalesce(~risk.is_trivial(F.col(col)) & risk.known_injection(F.col(col)).isNull(), F.lit(False))
    keyed = sealed(prompts.withColumn("prompt_key", F.when(open_one, js_trim(F.col(col)))))
    asked = keyed.where(F.col("prompt_key").isNotNull())
    if verdicts is None:
        if scorer is None:
            raise ValueError("give a verdict table or a scorer")
        keys = asked.select("prompt_key").dropDuplicates(["prompt_key"])
        verdicts = keys.withColumn("verdict", scorer(F.col("prompt_key")))
    else:
        order = F.struct(
            F.coalesce("verdict.risk", F.lit(False)), F.coalesce("verdict.confidence", F.lit(0.0)), F.to_json("verdict")
        )
        verdicts = verdicts.groupBy("prompt_key").agg(F.max_by("verdict", order).alias("verdict"))
    answered = asked.join(verdicts.select("prompt_key", "verdict"), "prompt_key", "left")
    # Settled prompts have no key to look up and are not sent to one place for it.
    settled = keyed.where(F.col("prompt_key").isNull())
    settled = settled.withColumn("verdict", F.lit(None).cast(verdicts.schema["verdict"].dataType))
    return answered.unionByName(settled).drop("prompt_key")


def analyze_prompts(prompts: DataFrame, col: str, verdict_col: str | None = None) -> DataFrame:
    """Add ``analysis`` (verdict, categories, confidence, tier)."""
    second = F.col(verdict_col) if verdict_col else None
    return prompts.withColumn("analysis", risk.analysis(F.col(col), second))


def guard_prompts(prompts: DataFrame, col: str, verdict_col: str | None = None) -> DataFrame:
    """Analysis plus what follows from it: ``guidance``, ``template_ids`` and ``blocked``."""
    work = analyze_prompts(prompts, col, verdict_col)
    categories = F.col("analysis.categories")
    blocked = (F.col("analysis.verdict") == "block") & risk.has_block(categories)
    return work.withColumns(
        {
            "blocked": blocked,
            "template_ids": risk.template_ids(categories),
            "guidance": F.when(blocked, "").otherwise(risk.build_guidance(categories)),
        }
    )


def flagged_prompts(prompts: DataFrame, col: str, verdict_col: str | None = None) -> DataFrame:
    """Guarded prompts worth logging: whatever is not plainly allowed."""
    guarded = sealed(guard_prompts(prompts, col, verdict_col))
    return guarded.where(F.col("analysis.verdict") != "allow")


def risk_summary(security: DataFrame) -> DataFrame:
    """``metric, n``: flagged prompts, prompts with guidance, and prompts per category.

    Rows of the other guards share the log and are left out.
    """
    guard = security.where(
        F.col("kind").isNull()
        | ~F.col("kind").isin("command-guard", "action-guard", "action-guard-error")
    )
    injected = F.coalesce(F.col("guidance") != "", F.lit(False))
    names = F.concat(
        F.array(F.lit("total")),
        F.when(injected, F.array(F.lit("injected"))).otherwise(F.array().cast("array<string>")),
        F.transform(
            F.coalesce("categories", F.array().cast("array<string>")),
            lambda c: F.concat(F.lit("category:"), c),
        ),
    )
    return (
        guard.select(F.explode(names).alias("metric"))
        .groupBy("metric")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def rule_eval(judged: DataFrame, expected_col: str, verdict_col: str) -> DataFrame:
    """One row of recall and false-positive counts; a missing verdict is an error, never an allow."""
    expected = F.col(expected_col)
    got = F.coalesce(F.col(verdict_col), F.lit("ERROR"))
    risky = expected != "allow"

    def count(condition: Column) -> Column:
        return F.count_if(condition)

    return judged.agg(
        F.count(F.lit(1)).alias("cases"),
        count(got == expected).alias("correct"),
        count(risky).alias("risky"),
        count(risky & (got == expected)).alias("caught"),
        count(~risky).alias("benign"),
        count(~risky & ~got.isin("allow", "ERROR")).alias("false_positives"),
        count(got == "ERROR").alias("errors"),
    )
