"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Deeply nested payload types take one analyzer pass per level.
    "spark.sql.analyzer.maxIterations": "300",
}

# Keyed state of the stateful streaming operators.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(name: str = "guardlake", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which every executor can reach.

    Only a local-mode session without that setting (tests, laptops) gets a temporary folder instead.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.gettempdir() + "/guardlake"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all cores when the input has fewer than two splits for each of them.

    Text scanning is CPU-bound, and a file with one row group is one task however large it is: its other splits are empty.
    Spark cuts any file of some size into as many splits as there are cores, so only more of them than that show that the
    input fills the cluster, and then it passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(cores, *keys)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is executed here leaves no shuffle files behind: its result is read from where it was written or collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialized(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives lost executors."""
    return packed(df, shared_dir(df.sparkSession, purpose))


def packed(df: DataFrame, path: str) -> DataFrame:
    """As ``materialized``, below a given path."""
    spark = df.sparkSession
    with passing_shuffles(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(df: DataFrame, path: str, *keys: str) -> DataFrame:
    """As ``packed``, in buckets of ``keys``: joined or grouped by them, its rows do not move again.

    There are as many buckets as shuffle partitions, so rows that are dealt by ``keys`` make few files. The table is in the
    catalog only while it is written; its files stay.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").mode("overwrite").option("compression", "zstd").option("path", path)
    with passing_shuffles(spark):
        writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table
