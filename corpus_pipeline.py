"""From raw documents to packed training sequences, one table per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from guardlake.llm import common, stages

STAGES = [
    ("toxicity", stages.toxic),
    ("line_dedup", stages.lines),
    ("simhash_dedup", stages.near_copies),
    ("packing", stages.packed),
]

# Toxicity scores and token ids are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order, each to the written and reread result of the one before."""
    docs = common.load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
