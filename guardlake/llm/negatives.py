"""Hard negatives by rotated one-bit codes, interval bounds and exact scores of what the bounds leave."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.llm import common

# Anchors that are searched for in one pass, and whose vectors and best rows are held at a time; anchors of a block.
CHUNK, BLOCK = 8192, 256
# Components count up to this size on either side: their products then add up exactly in 64 bits.
LIMIT = 1 << 24
# Levels on each side of zero, and bit planes, of an anchor's rotated components; pairs scored exactly at a time.
LEVELS, PLANES, PAIRS = 31, 6, 1 << 15
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def rotated(ints: np.ndarray) -> np.ndarray:
    """Rows padded to a power of two and turned by random signs and Hadamard transforms, twice.

    Sums and differences of whole numbers: exact, the same on every machine, and longer by the padded size.
    """
    n, size = ints.shape
    wide = 1 << max(size - 1, 0).bit_length()
    out = np.zeros((n, wide))
    out[:, :size] = ints
    rng = np.random.default_rng(wide)
    for _ in range(2):
        out *= rng.choice([-1.0, 1.0], wide)
        step = 1
        while step < wide:
            pairs = out.reshape(n, -1, 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, wide)
            step *= 2
    return out


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("u8")


class Codes(NamedTuple):
    """One-bit codes of vectors: signs of the rotated components, length, and alignment of code and vector.

    The alignment is the cosine of the vector and its code, taken as a vector of equal positive and negative parts.
    """

    bits: np.ndarray
    length: np.ndarray
    alignment: np.ndarray


def encode(ints: np.ndarray) -> Codes:
    turned = rotated(ints)
    length = np.sqrt((turned**2).sum(axis=1))
    whole = np.sqrt(turned.shape[1]) * np.where(length > 0, length, 1)
    return Codes(words(turned > 0), length, np.minimum(np.abs(turned).sum(axis=1) / whole, 1.0))


def intervals(anchors: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimated, lowest and highest possible inner product of every anchor (rotated) with every coded vector.

    The anchor is cut into whole levels, whose product with the code is a few popcounts; what the levels miss is at
    most its length. A vector is ``length * (alignment * code + rest)``, where the rest is orthogonal to the code and
    of known length; its product with the anchor is, by Cauchy and Schwarz, at most that length times the length of
    the anchor's own part orthogonal to the code.
    """
    wide = anchors.shape[1]
    step = np.abs(anchors).max(axis=1, keepdims=True) / LEVELS
    step = np.where(step > 0, step, 1.0)
    levels = np.rint(anchors / step).astype("i8")
    missed = np.sqrt(((anchors - step * levels) ** 2).sum(axis=1))
    lifted = (levels + LEVELS + 1).astype("u1")
    total = np.zeros((len(anchors), len(codes.bits)), "i8")
    ones = np.bitwise_count(codes.bits).sum(axis=1, dtype="i8")
    for plane in range(PLANES):
        mask = words(lifted >> plane & 1)
        for word in range(mask.shape[1]):
            total += np.bitwise_count(mask[:, word, None] & codes.bits[None, :, word]).astype("i8") << plane
    # Of bits to signs: twice the marked levels less all of them.
    signed = 2 * (total - (LEVELS + 1) * ones) - levels.sum(axis=1)[:, None]
    along = signed * (step / np.sqrt(wide))
    error = missed[:, None]
    across = np.maximum((anchors**2).sum(axis=1)[:, None] - np.maximum(np.abs(along) - error, 0) ** 2, 0)
    spread = codes.alignment * error + np.sqrt(1 - codes.alignment**2) * np.sqrt(across)
    # Two transforms made both sides longer by the padded size.
    scale = codes.length / float(wide) ** 2
    middle = codes.alignment * along * scale
    # Roots and products are rounded.
    spread = spread * scale + 1e-9 * (1 + np.abs(middle) + np.sqrt((anchors**2).sum(axis=1))[:, None] * scale)
    return middle, middle - spread, middle + spread


class Block(NamedTuple):
    """Anchors of one length and label: their places in the chunk, rows, vectors as given and rotated."""

    size: int
    label: str
    at: np.ndarray
    rows: np.ndarray
    ints: np.ndarray
    turned: np.ndarray


class Best:
    """Per anchor and window the first ``most`` rows by score (highest first), then key (smallest first, null last)."""

    def __init__(self, low: np.ndarray, high: np.ndarray, most: int):
        # Scores count from ``low`` to ``high``, both inclusive.
        self.low, self.high, self.most = low, high, most
        self.score = np.full((*low.shape, most), LOWEST)
        self.key = np.zeros((*low.shape, most), "i8")
        self.null = np.zeros((*low.shape, most), bool)

    def floor(self, at: np.ndarray) -> np.ndarray:
        """The lowest score that can still matter for an anchor."""
        return np.maximum(self.low[at], self.score[at, :, -1]).min(axis=1)

    def add(self, at: np.ndarray, score: np.ndarray, key: np.ndarray, null: np.ndarray) -> None:
        """Merge scored pairs; ``at`` are places of anchors."""
        touched = np.unique(at)
        for window in range(self.low.shape[1]):
            fits = (self.low[at, window] <= score) & (score <= self.high[at, window])
            fits &= score >= self.score[at, window, -1]
            place = np.concatenate([at[fits], np.repeat(touched, self.most)])
            parts = (score, self.score), (key, self.key), (null, self.null)
            s, k, z = (np.concatenate([new[fits], old[touched, window].ravel()]) for new, old in parts)
            order = np.lexsort((k, z, -s, place))
            place, s, k, z = place[order], s[order], k[order], z[order]
            rank = np.arange(len(place)) - np.searchsorted(place, place)
            some = rank < self.most
            for new, old in ((s, self.score), (k, self.key), (z, self.null)):
                old[place[some], window, rank[some]] = new[some]


def search(blocks: list[Block], best: Best, same: bool, rows: pd.DataFrame) -> int:
    """Let a batch of coded rows of one length meet anchors: of the same label, or of another. Gives the pairs scored.

    Pairs go by falling estimates, so that early exact scores raise the floor which the bounds of later ones must reach.
    """
    scored = 0
    labels, which = np.unique(rows["label"].to_numpy(str), return_inverse=True)
    numbers = {label: i for i, label in enumerate(labels.tolist())}
    size = int(rows["size"].iloc[0])
    ints = np.frombuffer(b"".join(rows["ints"]), "i8").reshape(len(rows), size)
    bits = np.frombuffer(b"".join(rows["bits"]), "u8").reshape(len(rows), -1)
    codes = Codes(bits, rows["length"].to_numpy(), rows["alignment"].to_numpy())
    null = rows["key"].isna().to_numpy()
    key, row = rows["key"].fillna(0).to_numpy("i8"), rows["row"].to_numpy("i8")
    for block in blocks:
        if block.size != size:
            continue
        own = which == numbers.get(block.label, -1)
        some = np.flatnonzero(own if same else ~own)
        if not len(some):
            continue
        middle, low, high = intervals(block.turned, Codes(*(x[some] for x in codes)))
        top = best.high[block.at].max(axis=1)
        i, j = np.nonzero((high >= best.floor(block.at)[:, None]) & (low <= top[:, None]))
        order = np.argsort(-middle[i, j], kind="stable")
        i, j = i[order], j[order]
        for start in range(0, len(i), PAIRS):
            a, b = i[start : start + PAIRS], j[start : start + PAIRS]
            still = (high[a, b] >= best.floor(block.at)[a]) & (block.rows[a] != row[some[b]])
            a, b = a[still], b[still]
            if len(a):
                exact = np.einsum("ij,ij->i", block.ints[a], ints[some[b]])
                best.add(block.at[a], exact, key[some[b]], null[some[b]])
                scored += len(a)
    return scored


def coded(vectors: DataFrame, anchors: Column, label: str, vector: str, key: str, scale: int, most: int) -> DataFrame:
    """Rows that can matter, with their codes: row, key, label, size, anchor, candidate, ints, bits, length, alignment.

    Equal vectors of a label score alike with everything. Only the ``most`` of them with the smallest keys can be
    among the first few of any anchor, so the others are no candidates; as anchors they stay.
    """
    kept = {"key": F.col(key).cast("long"), "label": F.col(label).cast("string"), "anchor": F.coalesce(anchors, F.lit(False))}
    ints = common.whole_vectors(vectors.where(F.col(label).isNotNull()), scale, LIMIT, vector, kept)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["ints"].map(len).to_numpy()
            for size in np.unique(sizes):
                some = batch[sizes == size].reset_index(drop=True)
                given = np.stack(some["ints"].to_numpy()).astype("i8").reshape(len(some), size)
                codes = encode(given)
                some["size"], some["ints"] = size, [x.tobytes() for x in given]
                some["bits"], some["length"], some["alignment"] = [x.tobytes() for x in codes.bits], codes.length, codes.alignment
                yield some

    shape = "key long, label string, anchor boolean, ints binary, size int, bits binary, length double, alignment double"
    rows = common.spread(ints).mapInPandas(packed, shape).withColumn("row", F.monotonically_increasing_id())
    rows = common.written(rows, "codes")
    rank = F.row_number().over(Window.partitionBy("label", "ints").orderBy(F.asc_nulls_last("key"), "row"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank").withColumn("candidate", F.lit(True))
    # Anchors that are no candidates are few: they are found by their number.
    spare = rows.where("anchor").join(first.where("anchor").select("row"), "row", "left_anti").withColumn("candidate", F.lit(False))
    return common.written(first.unionByName(spare), "candidates")


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    label: str = "label", vector: str = "embedding", key: str = "vec_id", chunk: int = CHUNK,
) -> DataFrame:
    """For each anchor its first rows of the same label, and for each of these the hardest rows of other labels. Exact.

    Components become ``floor(scale * x)``, scores are inner products of these whole numbers. A row follows another
    if its score is lower or, in a tie, its key larger (null keys last). A negative of a positive satisfies
    ``low * positive_score <= 100 * score <= high * positive_score``. Returns ``anchor_id``, ``positive_id``, ``rank``
    (from 1), ``negative_id``, ``positive_score``, ``negative_score``; nothing for a positive without negatives.

    Rows with a null label or vector, or null or non-finite components take no part. Every other row stands for
    itself: of repeated rows each is an anchor and can be another's positive. Rows meet rows of their own length
    only; components beyond 2^24 count as 2^24.

    Anchors are searched for by chunks of at most ``chunk``, whose vectors and best rows are all that is broadcast and
    all that a task keeps. For each chunk every task passes once over its rows for positives and once for negatives
    and hands on a few rows an anchor. Vectors do not move but for one grouping of equal ones.
    """
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    rows = coded(vectors, anchors, label, vector, key, scale, max(positives + 1, negatives))
    candidates = rows.where("candidate").select("row", "key", "label", "size", "ints", "bits", "length", "alignment")

    def found(blocks: list[Block], low: np.ndarray, high: np.ndarray, most: int, same: bool) -> DataFrame:
        # At most ``chunk`` anchors and a few scores for each.
        held = spark.sparkContext.broadcast((blocks, low, high))

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            blocks, low, high = held.value
            best = Best(low, high, most)
            for batch in batches:
                for _, some in batch.groupby("size", sort=False):
                    search(blocks, best, same, some)
            at, window, rank = np.nonzero(best.score > LOWEST)
            out = pd.DataFrame({"at": at, "window": window, "score": best.score[at, window, rank]})
            out["key"] = pd.array(best.key[at, window, rank], "Int64")
            out.loc[best.null[at, window, rank], "key"] = pd.NA
            yield out

        each = candidates.mapInPandas(of, "at int, window int, score long, key long")
        order = Window.partitionBy("at", "window").orderBy(F.desc("score"), F.asc_nulls_last("key"))
        first = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        return common.written(first, "found")

    out, last = [], None
    while True:
        # Ordered by the number of the row: the next chunk, and no more, comes to the driver.
        part = rows.where("anchor") if last is None else rows.where("anchor").where(F.col("row") > last)
        some = part.select("row", "key", "label", "size", "ints").orderBy("row").limit(chunk).collect()
        if not some:
            break
        last = some[-1]["row"]
        groups: dict[tuple, list[int]] = {}
        for i, row in enumerate(some):
            groups.setdefault((row["size"], row["label"]), []).append(i)
        blocks = []
        for (size, name), places in groups.items():
            for start in range(0, len(places), BLOCK):
                at = np.array(places[start : start + BLOCK])
                ints = np.frombuffer(b"".join(some[i]["ints"] for i in at), "i8").reshape(len(at), size)
                blocks.append(Block(size, name, at, np.array([some[i]["row"] for i in at]), ints, rotated(ints)))
        everything = np.full((len(some), 1), HIGHEST)
        near = found(blocks, -everything, everything, positives, True)
        least, most = np.full((len(some), positives), HIGHEST), np.full((len(some), positives), LOWEST)
        for row in near.select("at", "rank", "score").collect():
            least[row["at"], row["rank"] - 1] = -(-low * row["score"] // 100)
            most[row["at"], row["rank"] - 1] = high * row["score"] // 100
        hard = found(blocks, least, most, negatives, False)
        ids = spark.createDataFrame([(i, row["key"]) for i, row in enumerate(some)], "at int, anchor_id long")
        pairs = near.select("at", (F.col("rank") - 1).alias("window"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
        kept = hard.select("at", "window", "rank", F.col("key").alias("negative_id"), F.col("score").alias("negative_score"))
        joined = kept.join(pairs, ["at", "window"]).join(F.broadcast(ids), "at")
        out.append(
            common.written(
                joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"
            )
        )
    if not out:
        shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], shape)
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
