"""What several operators of this subpackage need: shared tables, bounded batches, spreading, components."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.session import passing_shuffles, removed, shared_dir

# Rows travel to Python workers in batches of at most this size, so that long texts bound their number.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, purpose: str, folder: str | None = None, **options: str) -> DataFrame:
    """Write a frame below ``spark.checkpoint.dir``, or as ``purpose`` in a given folder there, and read it back.

    Cuts lineage; the files lie in the folder that all executors share, so a lost executor loses nothing.
    ``options`` are those of the parquet writer.
    """
    spark = df.sparkSession
    path = f"{folder}/{purpose}" if folder else shared_dir(spark, purpose)
    with passing_shuffles(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wide(df: DataFrame) -> int:
    """Number of partitions for a keyed step: as the session's setting says."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over the cores if the input has fewer splits than there are cores.

    A file with one row group is one task however large it is. The result is the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"{base}_{uuid.uuid4().hex[:6]}"
    return base


def divided(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def held_out(doc_id: Column, remainder: int) -> Column:
    """True for rows whose crc32 of the id, written as text, leaves this remainder by 5; false for null ids."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % 5 == remainder, F.lit(False))


def whole_vectors(vectors: DataFrame, factor: int, limit: int, vector: str, keep: dict[str, Column]) -> DataFrame:
    """The columns of ``keep`` and ``ints``: floor(factor * x) of every component x, as a double.

    Rows whose vector is null or holds a null or non-finite component are left out. Numbers beyond ``limit`` on either
    side count as the limit, so that sums of products stay exact.
    """
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bounded = F.transform(
        vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * factor, F.lit(float(limit))), F.lit(-float(limit))))
    )
    return vectors.where(F.col(vector).isNotNull() & sound).select(*[c.alias(n) for n, c in keep.items()], bounded.alias("ints"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components: (a, b) long pairs in, (node, component) out, component being the smallest node.

    Alternating large-star and small-star steps (Kiveris and others, 2014). Every step groups by node with a
    combining minimum and joins it back, so a node with very many links is dealt like any skewed join, and
    nothing reaches the driver but two numbers a round. Nodes without links are not returned. Self loops and
    repeated pairs are harmless; null ends are ignored.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    folder = shared_dir(edges.sparkSession, "components")
    current = written(pairs.distinct(), "0", folder)
    mark = _mark(current)
    if not mark[0]:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for number in range(rounds):
        both = current.union(current.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = (
            large.join(least, large.a == least.n)
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("n", "m"))
            .where("a <> b")
            .distinct()
        )
        current = written(small, f"{number + 1}", folder)
        removed(edges.sparkSession, f"{folder}/{number}")
        before, mark = mark, _mark(current)
        if before == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _mark(pairs: DataFrame) -> tuple:
    """Count and an order-free sum of hashes: equal exactly when the pairs did not change."""
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(pairs.agg(F.count("*"), F.sum(h)).first())
