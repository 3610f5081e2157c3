"""Code scan over tables of files, and the findings of one conversation turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardlake.fixed import code as fixed
from guardlake.functions import code
from guardlake.functions.text import snapshot

FINDING_KEY = ["category", "line", "message"]


def scan_lines(df: DataFrame, col: str, keep: list[str], cap: int = 0) -> DataFrame:
    """One row per finding, over the whole content. A caller may limit it to its first ``cap`` characters."""
    listed = df.select(*keep, F.explode_outer(code.scan_code(snapshot(F.col(col), cap))).alias("_f"))
    return listed.where(F.col("_f.category").isNotNull()).select(*keep, "_f.*")


def merge_findings(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Both tiers, second-tier rows marked as such, one row per category, line and message."""
    both = first.unionByName(second.withColumn("tier", F.lit(2)))
    return both.groupBy(*keys, *FINDING_KEY).agg(F.min("tier").alias("tier"))


def accumulate_findings(findings: DataFrame, order: str, cap: int | None = None):
    """Per conversation the distinct findings, numbered in order of arrival; the first ``cap`` if given."""
    distinct = findings.groupBy("conv_id", *FINDING_KEY).agg(
        F.min(order).alias("first_seen"), F.max_by("tier", order).alias("tier")
    )
    place = Window.partitionBy("conv_id").orderBy("first_seen", *FINDING_KEY)
    numbered = distinct.withColumn("nth", F.row_number().over(place))
    return numbered if cap is None else numbered.where(F.col("nth") <= cap)


def pending_message(accumulated: DataFrame) -> DataFrame:
    """The note handed back to the agent: one bullet per finding, in order."""
    where = F.when(F.col("line") > 0, F.format_string(" line %d:", "line")).otherwise("")
    bullet = F.concat(F.lit("- ["), "category", F.lit("]"), where, F.lit(" "), "message")
    return (
        accumulated.groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array_sort(F.collect_list(F.struct("nth", bullet.alias("text")))).alias("_b"),
        )
        .select(
            "conv_id",
            "n",
            F.concat(
                F.lit(fixed.PENDING_HEADER), F.array_join(F.transform("_b", lambda b: b["text"]), "\n")
            ).alias("message"),
        )
    )


def finding_audit(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One audit row per scanned file with findings; the code itself is not carried along.

    A file has one finding per line and category at most.
    """
    one = F.struct("line", "category", "tier", "message")
    return findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_findings"), F.array_sort(F.collect_list(one)).alias("findings")
    )
