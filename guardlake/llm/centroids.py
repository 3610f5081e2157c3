"""Centroid clustering of integer vectors, with a vantage-point tree over the centroids of each round."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake.llm import common

# Centroids of a leaf of the tree; integer components count up to this size; distances and sums do up to LONG.
LEAF, LIMIT, LONG = 2, 1 << 40, (1 << 63) - 1
# Rows whose components a task adds up in 64 bits before it hands them on.
ADDED = 1 << 22


class Node(NamedTuple):
    """Centroids measured at this node (an inner node's vantage point alone), and its two children with the ranges of
    their distances from the vantage point."""

    members: list[int]
    children: list[tuple[int, float, float]]


def squares(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row from every point, as integers of any size."""
    top = max((int(np.abs(x).max()) for x in (rows, points) if x.size), default=0)
    if (2 * top) ** 2 * max(rows.shape[1], 1) > LONG:
        rows, points = rows.astype(object), points.astype(object)
    return np.stack([((rows - point) ** 2).sum(axis=1) for point in points], axis=1)


class Tree:
    """A vantage-point tree: the nearest point in Euclidean distance, the one with the smaller number in a tie."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf, self.nodes = points, leaf, []
        self._grow(list(range(len(points))))

    def _grow(self, some: list[int]) -> int:
        at = len(self.nodes)
        self.nodes.append(Node(some, []))
        if len(some) > self.leaf:
            far = np.sqrt(squares(self.points[some[1:]], self.points[some[:1]])[:, 0].astype("f8"))
            order = np.argsort(far, kind="stable")
            self.nodes[at] = Node(some[:1], [])
            for half in np.array_split(order, 2):
                if len(half):
                    child = self._grow([some[1 + i] for i in half])
                    self.nodes[at].children.append((child, far[half].min(), far[half].max()))
        return at

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of and squared distance to the nearest point for every row, and how many distances were worked out.

        Each row has its own list of open nodes with lower bounds of the distances below them and always goes on with
        the one of the smallest bound, until that exceeds its best distance; a bound that equals it is followed, as
        a point with a smaller number may lie there. Rows at the same node are measured together.
        """
        n, measured = len(rows), 0
        best, who = np.full(n, LONG, object if rows.dtype == object else "i8"), np.full(n, len(self.points))
        bound, node, used = np.full((n, 4), np.inf), np.zeros((n, 4), "i4"), np.ones(n, "i8")
        reach = np.full(n, np.inf)
        bound[:, 0] = 0
        active = np.arange(n if len(self.points) else 0)
        while True:
            slot = bound[active].argmin(axis=1)
            least = bound[active, slot]
            on = (least <= reach[active]) & (least < np.inf)
            active, slot = active[on], slot[on]
            if not len(active):
                return who, best, measured
            if used.max() + 2 > bound.shape[1]:
                bound = np.concatenate([bound, np.full(bound.shape, np.inf)], axis=1)
                node = np.concatenate([node, np.zeros(node.shape, "i4")], axis=1)
            chosen = node[active, slot]
            bound[active, slot] = np.inf
            for number in np.unique(chosen):
                at, here = active[chosen == number], self.nodes[number]
                found = squares(rows[at], self.points[here.members])
                measured += found.size
                for i, member in enumerate(here.members):
                    distance = found[:, i]
                    if best.dtype != object and distance.dtype == object:
                        best = best.astype(object)
                    new = who[at] == len(self.points)
                    closer = new | (distance < best[at]) | ((distance == best[at]) & (member < who[at]))
                    best[at[closer]], who[at[closer]] = distance[closer], member
                reach[at] = np.sqrt(best[at].astype("f8"))
                for child, low, high in here.children:
                    away = np.sqrt(found[:, 0].astype("f8"))
                    # Roots are rounded: a bound is taken a little lower than it comes out.
                    bound[at, used[at]] = np.maximum(np.maximum(away - high, low - away) - 1e-9 * (1 + away + high), 0)
                    node[at, used[at]] = child
                    used[at] += 1


class Clustering(NamedTuple):
    """``rows``: key, ``ints``, ``cluster``, ``distance`` per kept vector; ``centroids``: the final ones, by number."""

    rows: DataFrame
    centroids: list[list[int]]



def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3", vector: str = "embedding",
    key: str = "vec_id",
) -> Clustering:
    """Lloyd's rounds on ``floor(scale * x)``, exactly, in whole numbers.

    Vectors with exactly ``size`` components, none null or non-finite, are kept, whatever their key. The first
    centroids are the k of them with the smallest sha256 of ``<seed>:<key>`` (ties: smaller vector; null keys last);
    all of them, if fewer. Each round assigns every vector to its nearest centroid (ties: smaller number) and replaces
    every non-empty centroid by the floor of its vectors' means; empty ones stay. Repeated rows count each. Components
    beyond 2^40 count as 2^40, and distances beyond a long's range are given as its largest number.

    Only centroids reach the driver: k rows at first and k sums of ``size`` numbers a round, which every task adds
    up beforehand. The tree over them is broadcast; k and ``size`` bound it.
    """
    spark = vectors.sparkSession
    kept = common.whole_vectors(vectors.where(F.size(vector) == size), scale, LIMIT, vector, {"key": F.col(key)})
    kept = common.written(common.spread(kept), "integers")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = kept.select("ints", mark.alias("mark")).orderBy(F.asc_nulls_last("mark"), "ints").limit(k).collect()
    points = np.array([row["ints"] for row in first], "i8").reshape(len(first), size)

    def summed(tree) -> list:
        def of(batches: Iterator) -> Iterator:
            sums, rows = np.zeros((len(tree.value.points), size + 1), "i8"), 0

            def out():
                some = np.flatnonzero(sums[:, -1])
                return pd.DataFrame({"cluster": some.astype("i4"), "sums": list(sums[some])})

            for batch in batches:
                ints = np.stack(batch["ints"].to_numpy())
                who = tree.value.nearest(ints)[0]
                np.add.at(sums, who, np.concatenate([ints, np.ones((len(ints), 1), "i8")], axis=1))
                rows += len(ints)
                if rows > ADDED:
                    yield out()
                    sums[:], rows = 0, 0
            yield out()

        parts = kept.select("ints").mapInPandas(of, "cluster int, sums array<long>")
        each = parts.select("cluster", F.posexplode("sums").alias("place", "part"))
        return each.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()

    for _ in range(rounds if len(points) else 0):
        tree = spark.sparkContext.broadcast(Tree(points))
        totals = {(row["cluster"], row["place"]): int(row["total"]) for row in summed(tree)}
        tree.unpersist()
        points = np.array(
            [
                [totals[c, i] // totals[c, size] for i in range(size)] if (c, size) in totals else list(point)
                for c, point in enumerate(points)
            ],
            "i8",
        )
    tree = spark.sparkContext.broadcast(Tree(points))

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            who, best, _ = tree.value.nearest(np.stack(batch["ints"].to_numpy()))
            batch["cluster"], batch["distance"] = who.astype("i4"), np.minimum(best, LONG).astype("i8")
            yield batch

    kind = kept.schema["key"].dataType.simpleString()
    rows = kept.mapInPandas(assigned, f"key {kind}, ints array<long>, cluster int, distance long")
    return Clustering(rows.withColumnRenamed("key", key), points.tolist())


def report(found: Clustering, key: str = "vec_id") -> DataFrame:
    """Key, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` per kept vector."""
    rows = common.written(found.rows.select(key, "cluster", "distance"), "assigned")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {row["cluster"]: int(row["total"]) for row in rows.groupBy("cluster").agg(total.alias("total")).collect()}
    inertia = sum(sums.values())
    each = [
        (c, min(sums.get(c, 0), LONG), min(inertia, LONG), hashlib.sha256(",".join(map(str, point)).encode()).hexdigest())
        for c, point in enumerate(found.centroids)
    ]
    # One row a centroid.
    table = rows.sparkSession.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select(
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
