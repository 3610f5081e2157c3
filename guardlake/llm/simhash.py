"""Near-duplicate documents by 64-bit SimHash, found with BK-trees over shards of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from guardlake.llm import common, shingles

# The 64 bits fall into this many bands; all but RADIUS of them agree between two linked fingerprints.
BANDS = 4
# Fingerprints in one tree. Larger buckets become several trees, and each of their rows asks every tree.
TREE_ROWS = 4096
# Near copies: fingerprints of word sets meet within this many bits, and of the first so many found the nearest counts.
WIDE, WIDE_BANDS, LOOKED_AT = 6, 8, 16
ALL = (1 << 64) - 1
BUCKET = ["choice", "bits", "tree", "other"]


class BKTree:
    """Fingerprints, as numbers from 0 on, by Hamming distance: each child hangs on the edge numbered by its distance to its parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Index of the value's node, a new one unless the value is there."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while True:
            distance = (self.values[at] ^ value).bit_count()
            if not distance:
                return at
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Indexes of nodes at most ``radius`` bits away; only edges the triangle inequality allows are followed."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            children = self.children[at]
            if len(children) > 2 * radius + 1:
                stack.extend(c for d in range(distance - radius, distance + radius + 1) if (c := children.get(d)) is not None)
            else:
                stack.extend(c for d, c in children.items() if -radius <= d - distance <= radius)


class Forest:
    """Union-find over the fingerprints of one bucket, so that a bucket yields a spanning star, not all pairs.

    ``trees`` counts the components among the values that were added.
    """

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.trees = 0

    def root(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def link(self, x: int, near: Iterator[int], added: bool) -> None:
        """Join x to the values near it. Once every component is reached, the others need not be looked for."""
        reached: set[int] = set()
        for y in near:
            reached.add(self.root(y))
            if len(reached) == self.trees:
                break
        if reached:
            low = min(x, *reached)
            for r in (x, *reached):
                self.parent[r] = low
            self.trees -= len(reached) - 1
        elif added:
            self.root(x)
            self.trees += 1

    def stars(self) -> Iterator[tuple[int, int]]:
        for x in self.parent:
            if (r := self.root(x)) != x:
                yield x, r


def fingerprint(text: Column, shingle: int) -> Column:
    """SimHash of a text as a signed long; null counts as empty, a text without words gives zero.

    A-Z are lower-cased, words are runs of other characters than the six ASCII spaces. Shingles count as often as
    they occur; a text with fewer words is one shingle. A bit is set if it is in more than half of their hashes.
    """
    return simhash(F.coalesce(text, F.lit("")), F.lit(shingle))


@F.pandas_udf(LongType())
def simhash(texts: pd.Series, size: pd.Series) -> pd.Series:
    """Majority bits over the XXH64 hashes (seed 42) of each text's shingles."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), dtype=np.uint64)
    for i, (text, k) in enumerate(zip(texts, size)):
        # On bytes, lower() changes A-Z only, and split() splits at the six ASCII spaces only.
        words = text.encode().lower().split()
        if not words:
            continue
        n = max(len(words) - k + 1, 1)
        grams = map(b" ".join, zip(*(words[j:] for j in range(k)))) if len(words) >= k else [b" ".join(words)]
        out[i] = shingles.majority(np.fromiter((xxh64_intdigest(g, 42) for g in grams), dtype="<u8", count=n))
    return pd.Series(out.view(np.int64))


def _keys(fp: Column, radius: int, bands: int) -> Column:
    """Every choice of ``bands - radius`` bands with its bits: linked fingerprints agree on one at least."""
    from itertools import combinations

    edges = [64 * i // bands for i in range(bands + 1)]
    structs = []
    for number, chosen in enumerate(combinations(range(bands), bands - radius)):
        mask = sum(((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in chosen)
        structs.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(_signed(mask))).alias("bits")))
    return F.array(*structs)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _link_buckets(radius: int):
    """Walk rows sorted by bucket, tree rows first; yield the star edges of each bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tree, forest, found = None, BKTree(), Forest(), []

        def flush() -> None:
            found.extend((_signed(a), _signed(b)) for a, b in forest.stars())

        for batch in batches:
            for *bucket, ask, fp in batch[[*BUCKET, "ask", "fp"]].itertuples(index=False, name=None):
                if bucket != key:
                    flush()
                    key, tree, forest = bucket, BKTree(), Forest()
                fp &= ALL
                forest.link(fp, (tree.values[i] for i in tree.within(fp, radius)), not ask)
                if not ask:
                    tree.add(fp)
            if len(found) >= 50_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        flush()
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _nearest(radius: int):
    """Walk rows sorted by bucket, tree rows first; yield for each the nearest of the first fingerprints found near it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tree = None, BKTree()
        for batch in batches:
            found = []
            for *bucket, ask, fp in batch[[*BUCKET, "ask", "fp"]].itertuples(index=False, name=None):
                if bucket != key:
                    key, tree = bucket, BKTree()
                fp &= ALL
                near = [tree.values[i] for i in islice(tree.within(fp, radius), LOOKED_AT)]
                if near:
                    found.append((_signed(fp), _signed(min(near, key=lambda x: (x ^ fp).bit_count()))))
                if not ask:
                    tree.add(fp)
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _sharded(prints: DataFrame, radius: int, bands: int, tree_rows: int) -> DataFrame:
    """Rows of ``links`` by bucket, dealt to tasks."""
    rows = prints.select("fp", F.explode(_keys(F.col("fp"), radius, bands)).alias("k")).select("fp", "k.*")
    sizes = rows.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["choice", "bits"])
    shards = F.ceil(F.col("n") / tree_rows).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), shards).cast("int"))
    # (tree, other): in the shard pair of two numbers the smaller one grows the tree and the other one asks.
    pairs = F.transform(
        F.sequence(F.lit(0), shards - 1),
        lambda i: F.struct(
            F.least("own", i).alias("tree"), F.greatest("own", i).alias("other"), (F.col("own") > i).alias("ask")
        ),
    )
    rows = rows.select("choice", "bits", "fp", F.explode(pairs).alias("p")).select("choice", "bits", "p.*", "fp")
    common.bounded_batches(prints.sparkSession)
    return rows.repartition(common.wide(prints), *BUCKET).sortWithinPartitions(*BUCKET, "ask", "fp")


def links(prints: DataFrame, radius: int = 2, bands: int = BANDS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints ``fp`` (distinct longs) at most ``radius`` bits apart.

    Fingerprints meet in buckets that agree on ``bands - radius`` of the bands. A bucket with up to ``tree_rows``
    rows is one shard: one BK-tree, asked by its own rows while it grows. A larger one is dealt by hash into several
    shards, whose bounded trees are sent to the rows of each shard of the bucket, every pair of shards once.
    No bucket is left out. The edges are spanning stars of what is linked within a bucket or pair of shards.
    """
    return _sharded(prints, radius, bands, tree_rows).mapInPandas(_link_buckets(radius), "a long, b long")


def candidates(sets: DataFrame, radius: int = WIDE, bands: int = WIDE_BANDS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Pairs (a, b) of sets (``id``, ``fp``) whose fingerprints are at most ``radius`` bits apart, not all of them.

    Sets of one fingerprint meet its smallest ``id``, and that one the nearest in each bucket and tree, so there are
    at most as many pairs as rows in buckets, however many copies have fingerprints close together.
    """
    prints = common.written(sets.groupBy("fp").agg(F.min("id").alias("id")), "wide-prints")
    edges = _sharded(prints.select("fp"), radius, bands, tree_rows).mapInPandas(_nearest(radius), "a long, b long").distinct()
    one = prints.select(F.col("fp").alias("a"), F.col("id").alias("x"))
    other = prints.select(F.col("fp").alias("b"), F.col("id").alias("y"))
    near = edges.join(one, "a").join(other, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = sets.join(prints.withColumnRenamed("id", "head"), "fp").where("id <> head")
    return near.unionByName(equal.select(F.col("id").alias("a"), F.col("head").alias("b")))


def _classified(prints: DataFrame, radius: int, bands: int) -> DataFrame:
    """(fp, key) rows in; (fp, component_id) out, one row per fingerprint."""
    classes = common.written(prints.groupBy("fp").agg(F.min("key").alias("key")), "classes")
    parts = common.components(links(classes.select("fp"), radius, bands))
    named = classes.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", "key", F.coalesce("component", "fp").alias("part")
    )
    smallest = named.groupBy("part").agg(F.min("key").alias("component_id"))
    return named.join(smallest, "part").select("fp", "component_id")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """One row per document: key, ``fp`` and ``component_id``, the smallest key it reaches over links.

    Equal fingerprints count as one node, so a group of exact copies costs one row from there on. Null texts
    count as empty. Every row of a repeated key is returned. Rows with a null key link to others but never name a
    component, unless all keys of it are null; then ``component_id`` is null.
    """
    common.bounded_batches(docs.sparkSession)
    rows = common.spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    prints = common.written(rows.select("key", fingerprint(F.col("text"), shingle).alias("fp")), "fingerprints")
    return prints.join(_classified(prints, radius, BANDS), "fp").select(F.col("key").alias(key), "fp", "component_id")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Keep one document of each component: the one with the smallest key; columns as given.

    Documents are linked if the Jaccard similarity of their sets of shingles is ``least`` or more. Fingerprints of these
    sets, near each other in BK-trees, give candidates; each is confirmed on the texts. As fingerprints do not decide
    this at any radius (see README), ``shingles.similar`` adds the pairs that they miss. Of several
    rows with that very key one is kept, the same in every run. Texts without any word are linked with each other as
    equal. Columns of map type take no part in telling rows of one key apart.
    """
    named = docs.withColumns(
        {
            (k := common.fresh(docs, "_k")): F.coalesce(F.col(key), F.lit(0)),
            (null := common.fresh(docs, "_null")): F.col(key).isNull(),
            (row := common.fresh(docs, "_row")): F.xxhash64(
                *[F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() != "map"]
            ),
        }
    )
    rows = named.select(
        F.col(key).alias("key"), F.col(k).alias("k"), F.col(null).alias("null"), F.col(row).alias("row"), F.col(text).alias("text")
    )
    prints, parts = shingles.similar(common.spread(rows), shingle, least, candidates)
    parted = prints.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id"))
    smallest = parted.groupBy("part").agg(F.min("key").alias("smallest"))
    kept = (
        parted.join(smallest, "part")
        .where(F.col("key").eqNullSafe(F.col("smallest")))
        .groupBy(F.col("k").alias(k), F.col("null").alias(null))
        .agg(F.min("row").alias(row))
    )
    kept = common.written(kept, "kept")
    # What is left of a key agrees in all columns, and the join has brought it together.
    return named.join(kept, [k, null, row], "left_semi").dropDuplicates([k, null, row]).select(*docs.columns)
