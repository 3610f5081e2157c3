"""Near-duplicate embeddings by an exact, PCA-ordered comparison of tiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake.llm import common

# Vectors of a tile, and leading coordinates by which tiles are laid out and pairs of them ruled out.
TILE, GRID = 1024, 2
# Vectors from which the order of dimensions is taken; only the amount of work depends on them.
SAMPLE = 4096
# What sums in another order of dimensions may differ by; pairs this close are decided by the given dimensions.
SLACK = 1e-9


def rotations(classes: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Per number of dimensions the principal axes of unit vectors, from a sample of at most ``sample`` chosen by hash."""
    rows = classes.orderBy(F.xxhash64("embedding")).limit(sample).select("embedding").collect()
    by_size: dict[int, list] = {}
    for row in rows:
        by_size.setdefault(len(row["embedding"]), []).append(row["embedding"])
    axes = {}
    for size, vectors in by_size.items():
        values, found = np.linalg.eigh(np.cov(units(np.array(vectors, "f8")), rowvar=False, bias=True).reshape(size, size))
        axes[size] = found[:, np.argsort(-values)]
    return axes


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def rotated(vectors: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Unit vectors in the order of principal axes; as they are if the sample held none of this size."""
    out = units(vectors)
    return out @ axes[out.shape[1]] if out.shape[1] in axes else out


def linked(a: np.ndarray, b: np.ndarray, turned_a: np.ndarray, turned_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose cosine reaches the threshold.

    Products are summed over the leading dimensions first. What the others can add is at most the product of the
    norms of the rest, so a pair that cannot reach the threshold any more is dropped; few survive the first step. The
    survivors' cosines are taken from the vectors as given.
    """
    size = a.shape[1]
    cuts = sorted({min(size, max(2, size // n)) for n in (8, 4, 2, 1)})
    rest_a = np.sqrt(np.maximum(0, 1 - np.cumsum(turned_a**2, axis=1)))
    rest_b = np.sqrt(np.maximum(0, 1 - np.cumsum(turned_b**2, axis=1)))
    first = cuts[0]
    sums = turned_a[:, :first] @ turned_b[:, :first].T
    i, j = np.nonzero(sums + np.outer(rest_a[:, first - 1], rest_b[:, first - 1]) >= threshold - SLACK)
    sums = sums[i, j]
    for low, high in zip(cuts, cuts[1:]):
        kept_i, kept_j, kept = [], [], []
        for at in range(0, len(i), 1 << 17):
            pi, pj = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            total = sums[at : at + (1 << 17)] + np.einsum("ij,ij->i", turned_a[pi, low:high], turned_b[pj, low:high])
            still = total + rest_a[pi, high - 1] * rest_b[pj, high - 1] >= threshold - SLACK
            kept_i.append(pi[still]), kept_j.append(pj[still]), kept.append(total[still])
        i, j, sums = (np.concatenate(x) if x else np.empty(0, "i8") for x in (kept_i, kept_j, kept))
    norm_a, norm_b = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (a, b))
    out_i, out_j = [], []
    for at in range(0, len(i), 1 << 17):
        pi, pj = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
        cosine = np.einsum("ij,ij->i", a[pi], b[pj]) / (norm_a[pi] * norm_b[pj])
        out_i.append(pi[cosine >= threshold]), out_j.append(pj[cosine >= threshold])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.empty(0, "i8"), np.empty(0, "i8"))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches over pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, vector: str = "embedding", key: str = "vec_id", label: str = "label",
    tile: int = TILE, sample: int = SAMPLE,
) -> DataFrame:
    """One row per vector: key, ``n_links``, ``component_id``, ``kept``. Exact, for thresholds over 0.

    Vectors link if their labels are equal and not null and their cosine reaches the threshold. Null, empty and zero
    vectors and those with null or non-finite components link with nothing; nor do vectors of different lengths.
    Equal vectors of a label are one class with a count, so copies are never compared. A null key never names a
    component, unless all keys of it are null; such rows are not kept.

    Linked unit vectors differ by at most sqrt(2 - 2 * threshold) in any direction. So the leading two coordinates cut
    a label into cells of this width, cells into tiles of about ``tile`` rows, and only tiles of the same or touching
    cells are compared. A pair of tiles yields one row per linked vector: a count and a local root, not all pairs.
    """
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    sound = (
        F.col("label").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    grouped = rows.where(sound).groupBy("label", "embedding").agg(F.min("key").alias("key"), F.count("*").alias("copies"))
    classes = common.written(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    axes = spark.sparkContext.broadcast(rotations(classes, sample))
    width = math.sqrt(max(2 - 2 * threshold, 0)) + SLACK

    @F.pandas_udf("array<int>")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list = [None] * len(batch)
            sizes = batch.map(len)
            for _, at in sizes.groupby(sizes).indices.items():
                turned = rotated(np.stack(batch.iloc[at].to_numpy()).astype("f8"), axes.value)[:, :GRID]
                for i, place in zip(at, np.floor(turned / width).astype("i4").tolist()):
                    out[i] = place
            yield pd.Series(out)

    placed = classes.select("class", "label", "embedding", "copies", F.size("embedding").alias("size"), cell("embedding").alias("cell"))
    placed = common.written(placed, "placed")
    place = ["label", "size", "cell"]
    crowd = placed.groupBy(*place).agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / tile)).cast("int")
    dealt = placed.join(crowd, place).select("class", "copies", *place, part.alias("part"), "embedding")

    def bundle(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[[0]][[*place, "part"]].reset_index(drop=True)
        first["classes"] = [group["class"].to_numpy("i8").tobytes()]
        first["copies"] = [group["copies"].to_numpy("i8").tobytes()]
        first["data"] = [np.stack(group["embedding"].to_numpy()).astype("f4" if single else "f8").tobytes()]
        return first

    single = classes.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = classes.schema["label"].dataType.simpleString()
    shape = f"label {kind}, size int, cell array<int>, part int, classes binary, copies binary, data binary"
    # By part too: the rows of a crowded cell have come together for the count, and part again here.
    tiles = dealt.repartition(common.wide(vectors), *place, "part").groupBy(*place, "part").applyInPandas(bundle, shape)
    tiles = common.written(tiles.withColumn("tile", F.monotonically_increasing_id()), "tiles")

    steps = F.sequence(F.lit(-1), F.lit(1))
    ends = tiles.select("tile", "label", "size", "cell")
    around = ends.select(F.col("tile").alias("a"), "label", "size", "cell", F.explode(steps).alias("dx"))
    around = around.withColumn("dy", F.explode(steps)).select(
        "a",
        "label",
        "size",
        F.when(F.size("cell") > 1, F.array(F.get("cell", 0) + F.col("dx"), F.get("cell", 1) + F.col("dy")))
        .when(F.col("dy") == 0, F.array(F.get("cell", 0) + F.col("dx")))
        .alias("cell"),
    )
    pairs = around.join(ends.withColumnRenamed("tile", "b"), place).where("a <= b").select("a", "b")

    body = ["classes", "copies", "data"]
    left = tiles.select(F.col("tile").alias("a"), "size", *[F.col(c).alias(f"{c}_a") for c in body])
    right = tiles.select(F.col("tile").alias("b"), *[F.col(c).alias(f"{c}_b") for c in body])
    both = pairs.join(left, "a").join(right, "b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = "f4" if single else "f8"
        for batch in batches:
            for row in batch.itertuples(index=False):
                own = row.a == row.b
                a, b = (np.frombuffer(x, kind).reshape(-1, row.size).astype("f8") for x in (row.data_a, row.data_b))
                ids = np.concatenate([np.frombuffer(x, "i8") for x in ((row.classes_a,) if own else (row.classes_a, row.classes_b))])
                copies = np.concatenate([np.frombuffer(x, "i8") for x in ((row.copies_a,) if own else (row.copies_a, row.copies_b))])
                i, j = linked(a, b, rotated(a, axes.value), rotated(b, axes.value), threshold)
                if own:
                    i, j = i[i < j], j[i < j]
                else:
                    j = j + len(a)
                n = len(ids)
                links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
                some = np.flatnonzero(links)
                yield pd.DataFrame({"class": ids[some], "links": links[some].astype("i8"), "root": ids[roots(n, i, j)[some]]})

    # Many short comparisons: dealt evenly, whatever cells they belong to.
    found = both.repartition(common.wide(vectors), "a", "b").mapInPandas(compare, "class long, links long, root long")
    found = common.written(found, "links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    parts = common.components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = (
        classes.select("class", "label", "embedding", "key", "copies")
        .join(parts.withColumnRenamed("node", "class"), "class", "left")
        .join(links, "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    smallest = named.groupBy("component").agg(F.min("key").alias("component_id"))
    resolved = named.join(smallest, "component").select(
        "label", "embedding", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.lit(True).alias("sound")
    )
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("key"))
    return rows.join(resolved, ["label", "embedding"], "left").select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )
