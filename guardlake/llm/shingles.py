"""Texts with similar sets of word shingles, found whole: a prefix filter for candidates, then the sets themselves."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from guardlake.llm import common
from guardlake.session import passing_shuffles, removed, shared_dir

# Texts from which frequent shingles are learnt, and how many of these are kept. They order shingles and so change
# how much is compared, never what is found.
SAMPLE, FREQUENT = 20_000, 200_000
# Up to so many texts are picked out of all by a broadcast.
PICKED = 300_000
PRINT = StructType(
    [
        StructField("id", LongType()), StructField("n", LongType()), StructField("rare", LongType()), StructField("fp", LongType()),
        StructField("odd", ArrayType(LongType())), StructField("prefix", ArrayType(LongType())),
    ]
)


def shingles(text: str | None, size: int) -> set[bytes]:
    """Different runs of ``size`` words: A-Z lower-cased, words as in ``simhash.fingerprint``. Fewer words are one shingle."""
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[j:] for j in range(size)))))


def _hashes(text: str | None, size: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    found = shingles(text, size)
    return np.unique(np.fromiter((xxh64_intdigest(g, 42) for g in found), dtype="<u8", count=len(found)))


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in more than half of the hashes; zero if there are none."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return weights[ones * 2 > len(hashes)].sum(dtype=np.uint64)


def odd_bits(hashes: np.ndarray) -> np.ndarray:
    """An odd sketch (Mitzenmacher and others, 2014): of the next power of two of places, those to which an odd number of hashes
    falls, as longs. Two sets differ in at least as many members as their sketches in bits."""
    places = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(places - 1)).view(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def least_apart(one: Column, other: Column) -> Column:
    """Bits in which two sketches differ; the longer one, of at most twice as many places, is folded upon itself."""
    size = F.least(F.size(one), F.size(other))

    def folded(odd: Column) -> Column:
        halves = F.zip_with(F.slice(odd, 1, size), F.slice(odd, size + 1, size), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(odd) > size, halves).otherwise(odd)

    bits = F.zip_with(folded(one), folded(other), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda total, x: total + x)


def _identity(hashes: np.ndarray) -> int:
    """A number that equal sets share: 64 bits of the digest of the sorted hashes."""
    from hashlib import blake2b

    return int.from_bytes(blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sampled(size: int):
    @F.pandas_udf(StructType([StructField("id", LongType()), StructField("all", ArrayType(LongType()))]))
    def sets(texts: pd.Series) -> pd.DataFrame:
        found = [_hashes(t, size) for t in texts]
        return pd.DataFrame({"id": [_identity(h) for h in found], "all": [h.view(np.int64) for h in found]})

    return sets


def frequent(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of shingles that several texts of a sample share."""
    one_in = common.divided(rows.count(), SAMPLE)
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
    each = common.spread(chosen).select(_sampled(size)("text").alias("s")).select("s.*").dropDuplicates(["id"])
    counts = each.select(F.explode("all").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    with passing_shuffles(rows.sparkSession):
        top = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    hashes = top["h"].to_numpy("i8").view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], top["n"].to_numpy("i8")[order]


def _prints(size: int, least: float, known: np.ndarray, counts: np.ndarray):
    @F.pandas_udf(PRINT)
    def prints(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            own = _hashes(text, size)
            n = len(own)
            rank = np.zeros(n, dtype=np.int64)
            if len(known) and n:
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                rank = np.where(known[at] == own, counts[at], 0)
            first = np.lexsort((own, rank))[: n - math.ceil(least * n - 1e-9) + 1]
            fp = int(majority(own).view(np.int64))
            out.append((_identity(own), n, int((rank == 0).sum()), fp, odd_bits(own), own[first].view(np.int64)))
        return pd.DataFrame(out, columns=["id", "n", "rare", "fp", "odd", "prefix"])

    return prints


def _alike(size: int, least: float):
    @F.pandas_udf(BooleanType())
    def alike(one: pd.Series, other: pd.Series) -> pd.Series:
        last, mine, out = None, set(), []
        for a, b in zip(one, other):
            if a != last:
                last, mine = a, shingles(a, size)
            yours = shingles(b, size)
            both = len(mine & yours)
            out.append(both >= least * (len(mine) + len(yours) - both) - 1e-9)
        return pd.Series(out, dtype=bool)

    return alike


def _likely(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) but those whose sizes or sketches show that they are less similar than ``least``."""
    one = sketches.select(F.col("id").alias("a"), F.col("n").alias("x"), F.col("odd").alias("x_odd"))
    other = sketches.select(F.col("id").alias("b"), F.col("n").alias("y"), F.col("odd").alias("y_odd"))
    near = F.least("x", "y") >= least * F.greatest("x", "y") - 1e-9
    # Of x + y members, sets of this similarity differ in so many at most.
    few = least_apart(F.col("x_odd"), F.col("y_odd")) <= (1 - least) / (1 + least) * (F.col("x") + F.col("y")) + 1e-6
    return pairs.join(one, "a").join(other, "b").where(F.when(near, few).otherwise(False)).select("a", "b")


def _confirmed(pairs: DataFrame, rows: DataFrame, sketches: DataFrame, seats: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of ``least`` or more, counted on the shingles themselves.

    Pairs that only share a common shingle are many more than pairs that are similar, and grow faster than the texts: their
    sketches, a fiftieth of the texts, rule these out before any text moves."""
    spark = rows.sparkSession
    folder = shared_dir(spark, "confirmed")
    pairs = common.written(_likely(common.written(pairs, "pairs", folder), sketches, least), "candidates", folder)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    seated = common.written(seats.join(wanted, "id", "left_semi"), "seats", folder)
    few = F.broadcast(seated) if seated.count() <= PICKED else seated
    texts = rows.join(few, ["k", "null", "row"]).dropDuplicates(["id"]).select("id", "text")
    texts = common.written(texts, "texts", folder, compression="zstd")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("one")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("other")), "b")
    # Confirmed where they stand; the rows of a text that is in very many pairs are dealt anew.
    found = common.written(both.where(_alike(size, least)("one", "other")).select("a", "b"), "found", folder)
    removed(spark, *(f"{folder}/{name}" for name in ("pairs", "candidates", "seats", "texts")))
    return found


def similar(rows: DataFrame, size: int, least: float, near: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(prints, parts): the set number ``id`` of each row, and (node, component) for sets that others are similar to.

    ``near`` gives candidates (a, b) by the fingerprints (id, fp) of the sets. What these miss is found by shingles.

    Rows have ``text`` and what tells them apart: ``k``, ``null``, ``row``; prints carry all columns but the text.
    Two sets with a Jaccard similarity of ``least`` or more have at least one of the first ``n - ceil(least * n) + 1``
    shingles in common, in any order that is the same for all; rare ones come first. Sets meet where such a shingle
    agrees, and what follows it in both is long enough: first each with the most usual set there, and with sets of near
    fingerprints, then, of sets that are
    not connected by that, all with all. Every meeting pair is confirmed on its texts, so the components are exactly those of the similarity.
    """
    spark = rows.sparkSession
    common.bounded_batches(spark)
    folder = shared_dir(spark, "similar")

    def table(df: DataFrame, name: str, *read: str) -> DataFrame:
        """Written in the folder; ``read`` names the tables that nothing needs after this one."""
        out = common.written(df, name, folder)
        removed(spark, *(f"{folder}/{x}" for x in read))
        return out

    known, counts = frequent(rows, size)
    kept = [c for c in rows.columns if c != "text"]
    every = table(rows.select(*kept, _prints(size, least, known, counts)("text").alias("p")).select(*kept, "p.*"), "every")
    prints = table(every.drop("odd", "prefix"), "prints")
    seats = prints.groupBy("id").agg(F.min(F.struct("k", "null", "row")).alias("at")).select("id", "at.*")
    # Most shingles of a prefix occur once: numbers only are moved to find the others.
    sets = every.groupBy("id").agg(F.min(F.struct("n", "rare", "fp", "odd", "prefix")).alias("p")).select("id", "p.*")
    sets = table(sets, "sets", "every")
    sketches = table(sets.drop("prefix"), "sketches")
    shared = sets.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("members")).where("members > 1").select("h")
    shared = table(shared, "shared")
    places = table(sets.select("id", F.posexplode("prefix").alias("pos", "h")).join(shared, "h"), "places", "sets", "shared")
    entries = table(places.join(sketches.select("id", "n", "rare"), "id"), "entries", "places")
    firsts = entries.groupBy("h").agg(F.min(F.struct("rare", "id", "n", "pos")).alias("first"))
    meets = table(entries.join(firsts, "h").select("h", "id", "n", "pos", "first"), "meets", "entries")

    def fits(x: str, x_pos: str, y: str, y_pos: str):
        # Where a similar pair meets first, what both have from there on is enough.
        return F.least(F.col(x) - F.col(x_pos), F.col(y) - F.col(y_pos)) >= least / (1 + least) * (F.col(x) + F.col(y)) - 1e-9

    def paired(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    stars = meets.where((F.col("id") != F.col("first.id")) & fits("n", "pos", "first.n", "first.pos")).select(*paired("id", "first.id")).distinct()
    close = near(sketches.select("id", "fp")).select(*paired("a", "b"))
    tested = _confirmed(stars.unionByName(close).distinct(), rows, sketches, seats, size, least)
    parts = common.components(tested)
    named = meets.join(parts.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("h", "id", "n", "pos", F.coalesce("component", "id").alias("part"), F.col("first.id").alias("first"))
    named = table(named, "named", "meets")
    # Buckets that are one part by now have nothing left to compare.
    open_ = named.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("h")
    left = table(named.join(open_, "h", "left_semi"), "open", "named")
    other = left.select("h", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "pos", "part")))
    apart = (F.col("id") < F.col("id2")) & (F.col("part") != F.col("part2"))
    new = (F.col("id") != F.col("first")) & (F.col("id2") != F.col("first"))
    rest = left.join(other, "h").where(apart & new & fits("n", "pos", "n2", "pos2")).select(*paired("id", "id2")).distinct()
    more = _confirmed(rest, rows, sketches, seats, size, least)
    parts = common.components(tested.unionByName(more))
    removed(spark, *(f"{folder}/{x}" for x in ("sketches", "open")))
    return prints, parts
