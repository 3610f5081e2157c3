"""Command guard over tables of shell commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.fixed import commands as fixed
from guardlake.functions import commands
from guardlake.operators.barrier import sealed


def command_categories(spark: SparkSession) -> DataFrame:
    rows = [(i, e["category"], e["permission"]) for i, e in enumerate(fixed.COMMAND_CATEGORIES)]
    return spark.createDataFrame(rows, "place int, category string, permission string")


def classify_commands(df: DataFrame, col: str) -> DataFrame:
    """Add permission, category, matched_pattern and the two messages."""
    return _spread(df, commands.classify_command(F.col(col)))


def guard_commands(df: DataFrame, col: str) -> DataFrame:
    """As ``classify_commands``, failing closed: a null command is denied."""
    return _spread(df, commands.guard_command(F.col(col)))


def _spread(df: DataFrame, verdict) -> DataFrame:
    return df.withColumn("_verdict", verdict).select("*", "_verdict.*").drop("_verdict")


def command_log(df: DataFrame, col: str) -> DataFrame:
    """Guarded commands worth logging: denials and questions, never plain allows."""
    return sealed(guard_commands(df, col)).where(F.col("permission") != "allow")
