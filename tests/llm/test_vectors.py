"""Hard negatives and centroid clustering against plain versions, on awkward rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from guardlake.llm import centroids, common, negatives, queries
from tests.llm.helpers import rows_of

SCHEMA = "vec_id long, embedding array<double>, label int, key string, rank int, row long, at int, ints string"


def frame(spark, rows):
    """Vectors with columns that clash with names used inside the operators."""
    return spark.createDataFrame([(i, v, label, "k", 1, 2, 3, "x") for i, v, label in rows], SCHEMA)


def awkward(size=6, n=60, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(size)], rng.randrange(3)) for i in range(n)]
    rows += [(i + 1000, [x * 1.001 for x in v], (label + i) % 3) for i, v, label in rows[:25]]
    same = rows[0][1]
    rows += [(2000 + 10 * i, list(same), i % 2) for i in range(30)]
    rows += [rows[0], rows[0], (None, same, 0), (None, rows[5][1], 1), (100, rows[7][1], None), (200, None, 1)]
    rows += [(300, [1.0] * (size - 1) + [None], 1), (400, [math.nan] * size, 1), (500, [math.inf] * size, 2), (600, [0.0] * size, 1)]
    rows += [(700, [0.5, 0.25], 1), (701, [0.5, 0.2], 1), (702, [0.5, 0.24], 2), (800, [], 1), (801, [], 2), (900, [1e30] * size, 1)]
    return rows + [(902, [1e30] * (size - 1) + [-1e30], 2), (-100, [x / 2 for x in same], 1), (910, rows[3][1][:], 2)]


def whole(v, factor, limit):
    return [math.floor(max(min(x * factor, limit), -limit)) for x in v]


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_negatives(rows):
    rows = [(i, whole(v, 256, negatives.LIMIT), label) for i, v, label in rows if label is not None and sound(v)]
    out = []
    for a, (anchor, v, label) in enumerate(rows):
        if anchor is None or anchor % 100:
            continue
        others = [
            (-sum(x * y for x, y in zip(v, w)), i is None, i, other)
            for b, (i, w, other) in enumerate(rows)
            if a != b and len(v) == len(w)
        ]
        others.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        for s, _, i, _ in [r for r in others if r[3] == label][:5]:
            hard = [r for r in others if r[3] != label and -80 * s <= -100 * r[0] <= -100 * s][:5]
            out += [(anchor, i, rank + 1, r[2], -s, -r[0]) for rank, r in enumerate(hard)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("size,chunk", [(6, 8192), (1, 3), (70, 4)])
def test_negatives_by_brute_force(spark, size, chunk):
    rows = awkward(size)
    out = negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0, chunk=chunk)
    assert rows_of(out) == plain_negatives(rows)
    assert out.count() > 50


def test_negatives_of_nothing(spark):
    empty = frame(spark, awkward()).limit(0)
    assert negatives.mine(empty, F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(frame(spark, awkward()[:1]), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("size", [1, 2, 7, 64, 100])
def test_intervals_hold_the_products(size):
    rng = np.random.default_rng(size)
    rows = np.concatenate([rng.integers(-300, 300, (200, size)), np.zeros((2, size), "i8"), rng.integers(-(1 << 24), 1 << 24, (20, size))])
    rows = np.concatenate([rows, rows[:40] + rng.integers(-3, 4, (40, size))])
    middle, low, high = negatives.intervals(negatives.rotated(rows), negatives.encode(rows))
    exact = rows @ rows.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (low <= middle).all() and (middle <= high).all()


def test_intervals_leave_few_pairs(spark, sf):
    rows = common.load(spark, sf, "embeddings").toPandas()
    ints = np.floor(256 * np.stack(rows["embedding"]).astype("f8")).astype("i8")
    best = negatives.Best(np.full((1, 1), negatives.LOWEST), np.full((1, 1), negatives.HIGHEST), 5)
    codes = negatives.encode(ints)
    import pandas as pd

    table = pd.DataFrame({"row": range(len(ints)), "key": pd.array(rows["vec_id"], "Int64"), "label": "x", "size": 64})
    table["ints"], table["bits"] = [x.tobytes() for x in ints], [x.tobytes() for x in codes.bits]
    table["length"], table["alignment"] = codes.length, codes.alignment
    block = negatives.Block(64, "x", np.array([0]), np.array([0]), ints[:1], negatives.rotated(ints[:1]))
    scored = negatives.search([block], best, True, table)
    want = sorted(((-int(s), int(k)) for s, k in zip(ints[1:] @ ints[0], rows["vec_id"][1:])))[:5]
    assert list(zip((-best.score[0, 0]).tolist(), best.key[0, 0].tolist())) == want
    assert scored < len(ints)


def plain_clusters(rows, k, rounds, size):
    kept = [(i, whole(v, 1024, centroids.LIMIT)) for i, v, _ in rows if sound(v) and len(v) == size]

    def mark(row):
        return (row[0] is None, "" if row[0] is None else hashlib.sha256(f"3:{row[0]}".encode()).hexdigest(), row[1])

    points = [v for _, v in sorted(kept, key=mark)[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, p)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        points = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else p for c, p in enumerate(points)]
    found = [(i, *nearest(v)) for i, v in kept]
    top = (1 << 63) - 1
    total = sum(min(d, top) for _, d, _ in found)
    out = []
    for i, d, c in found:
        own = sum(min(e, top) for _, e, b in found if b == c)
        digest = hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()
        out.append((i, c, min(d, top), min(own, top), min(total, top), digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size,k", [(6, 8), (2, 3), (6, 40)])
def test_clusters_by_brute_force(spark, size, k):
    rows = awkward(size)
    out = centroids.report(centroids.cluster(frame(spark, rows), k=k, rounds=4, size=size))
    assert rows_of(out) == plain_clusters(rows, k, 4, size)


def test_clusters_of_few_vectors(spark):
    rows = [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (3, [-0.5, 0.0], None)]
    assert rows_of(centroids.report(centroids.cluster(frame(spark, rows), size=2))) == plain_clusters(rows, 8, 10, 2)
    assert centroids.report(centroids.cluster(frame(spark, rows), size=64)).count() == 0
    found = centroids.cluster(frame(spark, rows), size=2, k=1, rounds=1)
    assert len(found.centroids) == 1 and found.rows.columns == ["vec_id", "ints", "cluster", "distance"]


def test_tree_finds_the_nearest_with_few_distances():
    rng = np.random.default_rng(5)
    points = rng.integers(-1000, 1000, (400, 3))
    points = np.concatenate([points, points[:50]])
    rows = np.concatenate([rng.integers(-1000, 1000, (500, 3)), points, (points[:60] + points[60:120]) // 2])
    who, best, measured = centroids.Tree(points).nearest(rows)
    all_of_them = centroids.squares(rows, points)
    assert (who == all_of_them.argmin(axis=1)).all() and (best == all_of_them.min(axis=1)).all()
    assert measured < 0.2 * all_of_them.size
    who, best, _ = centroids.Tree(points[:1]).nearest(rows)
    assert (who == 0).all() and (best == all_of_them[:, 0]).all()


def test_whole_tables_by_brute_force(spark, sf):
    rows = [tuple(r) for r in common.load(spark, sf, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert rows_of(queries.op13_centroids(spark, sf)) == plain_clusters(rows, 8, 10, 64)
    shifted = [(i, v, (label + 1) % 10 if i % 7 == 0 and label is not None else label) for i, v, label in rows]
    assert rows_of(queries.op12_negatives(spark, sf)) == plain_negatives(shifted)
