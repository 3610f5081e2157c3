"""Document fingerprints by winnowing, and their likeness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardlake.llm import common

# Any passage of GRAM + WINDOW - 1 characters that two texts share leaves a fingerprint in both.
GRAM, WINDOW = 12, 16
# An odd base and its inverse modulo 2**64, and the multipliers that spread the rolling hashes' bits.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPREAD = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype="u8")
    if n:
        out[0] = 1
    return np.cumprod(out, dtype="u8")


def grams(text: str, k: int) -> np.ndarray:
    """Hashes (32 bits) of all runs of k characters; of the whole text if it is shorter, of nothing if it is empty.

    Rolling: a prefix sum over ``code * base**-i`` gives each run's polynomial by one difference and one product,
    modulo 2**64.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8") + np.uint64(1)
    n = len(codes)
    if not n:
        return np.empty(0, "u8")
    k = min(k, n)
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(codes * _powers(INVERSE, n), dtype="u8")])
    rolled = (sums[k:] - sums[:-k]) * _powers(BASE, n)[k - 1 :]
    for multiplier in SPREAD:
        rolled = (rolled ^ (rolled >> np.uint64(33))) * np.uint64(multiplier)
    return rolled >> np.uint64(32)


def winnow(text: str, k: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the selected runs: the minimum of each window, the rightmost of equal ones.

    A text with fewer runs than a window holds is one window; an empty text has no fingerprint.
    """
    hashes = grams(text, k)
    n = len(hashes)
    if not n:
        return np.empty(0, "u4"), np.empty(0, "i8")
    # One number orders by hash, then by position from the right.
    least = hashes << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype="u8"))
    width, held = min(window, n), 1
    while held < width:
        step = min(held, width - held)
        least = np.minimum(least[:-step], least[step:])
        held += step
    chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (chosen >> np.uint64(32)).astype("u4"), (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype("i8")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice coefficient of two sets of hashes; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) + len(b):
        return 1.0
    return 2.0 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def shown(hashes: np.ndarray) -> str:
    """Hashes in order, eight hex digits each."""
    return hashes.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as many characters from the beginning of another, or all it has."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row per selected run of each text: key, hash, position. Null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, value in zip(batch["key"], batch["text"]):
                hashes, at = winnow(value, k, window)
                yield pd.DataFrame({"key": pd.array([name] * len(at), dtype="object"), "hash": hashes.astype("i8"), "position": at})

    common.bounded_batches(docs.sparkSession)
    rows = common.spread(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, hash long, position long").withColumnRenamed("key", key)


def in_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (chunk, guest, key, text) such that a chunk sorted by guest, key downwards and text holds neighbours.

    Chunks cut the descending order of keys, nulls last, at quantiles of the keys, so equal keys share a chunk. The
    first document of the following chunk that has any (after the last one: of the first) comes as a guest.
    Only the cuts and the chunks' first keys, one each per chunk, reach the driver or are broadcast.
    """
    spark = docs.sparkSession
    chunks = 4 * common.wide(docs)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = rows.select("key")
    shares = [i / chunks for i in range(1, chunks)]
    cuts = sorted(set(keys.where("key is not null").approxQuantile("key", shares, 0.25 / chunks)), reverse=True)

    @F.pandas_udf("int")
    def chunk_of(key: pd.Series) -> pd.Series:
        # How many cuts lie above the key; nulls come after all others.
        above = len(cuts) - np.searchsorted(np.array(cuts[::-1]), key.to_numpy("float64", na_value=np.nan), side="right")
        return pd.Series(np.where(key.isna(), len(cuts) + 1, above).astype("int32"))

    chunk = chunk_of("key")
    firsts = keys.groupBy(chunk.alias("own")).agg(F.max("key").alias("first"))
    # As many rows as chunks at most; the one partition holds no more than that.
    order = Window.partitionBy(F.lit(0)).orderBy("own")
    last = F.max("own").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    hosts = firsts.select("own", "first", F.coalesce(F.lag("own").over(order), last).alias("host")).collect()
    schema = f"own int, first {docs.schema[key].dataType.simpleString()}, host int"
    hosts = spark.createDataFrame([tuple(r) for r in hosts], schema)
    own = rows.withColumn("own", chunk)
    visits = own.join(F.broadcast(hosts), "own", "left").select(
        "key",
        "text",
        F.explode(
            F.when(
                F.col("key").eqNullSafe(F.col("first")),
                F.array(
                    F.struct(F.col("own").alias("chunk"), F.lit(0).alias("guest")),
                    F.struct(F.col("host").alias("chunk"), F.lit(1).alias("guest")),
                ),
            ).otherwise(F.array(F.struct(F.col("own").alias("chunk"), F.lit(0).alias("guest"))))
        ).alias("v"),
    )
    return visits.select("v.chunk", "v.guest", "key", "text")


def compare_edits(
    docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = GRAM, window: int = WINDOW
) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and their likeness and that to the next document.

    The next document follows in descending order of keys, and the first one follows the last; nulls come last, ties
    are in order of their texts, and a single document follows itself. The edited text takes its last third from the
    beginning of the next document. Null texts count as empty. Every text is moved once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None  # the chunk, and the document that waits for its next one
        names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def row(key, text, own, following, after):
            changed = edited(text, following)
            other = winnow(changed, k, window)[0] if changed != text else own
            digest = hashlib.sha256(changed.encode()).hexdigest()
            return key, len(text), digest, shown(own), shown(other), likeness(own, other), likeness(own, after)

        for batch in batches:
            rows = []
            for chunk, guest, key, value in batch.itertuples(index=False, name=None):
                if guest and (held is None or chunk != at):
                    continue
                own = winnow(value, k, window)[0]
                if held is not None and chunk == at:
                    rows.append(row(*held, value, own))
                at, held = chunk, None if guest else (key, value, own)
            out = pd.DataFrame(rows, columns=names)
            out["key"] = pd.array(out["key"], dtype="object")
            yield out

    common.bounded_batches(docs.sparkSession)
    visits = in_chunks(common.spread(docs.select(key, text)), key, text)
    order = ["chunk", "guest", F.col("key").desc_nulls_last(), "text"]
    dealt = visits.repartition(common.wide(docs), "chunk").sortWithinPartitions(*order)
    schema = (
        f"key {docs.schema[key].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return dealt.mapInPandas(run, schema).withColumnRenamed("key", key)
