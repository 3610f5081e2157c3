"""Pack tokenised documents into sequences of fixed length by best-fit decreasing."""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardlake.llm import common

BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
# Characters that belong to the same classes in every Unicode version: the pattern below then cuts texts as the
# tokenizer itself does. Texts with others go through the tokenizer whole.
SAFE = "\t\n\r" + "".join(map(chr, [*range(0x20, 0x7F), *range(0xA1, 0x250)]))
# Pre-tokens in each of the two generations that a worker remembers.
REMEMBERED = 250_000


def _class(kind: str) -> str:
    """The safe characters of a Unicode category, for use between square brackets."""
    return "".join(re.escape(c) for c in SAFE if unicodedata.category(c).startswith(kind))


def _pre_tokens() -> str:
    """The pre-tokens of byte-level BPE, for texts of safe characters."""
    letters, numbers = _class("L"), _class("N")
    return rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, int]:
    """What byte-level BPE writes for bytes: printable ones as themselves, the others as letters from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: 0x100 + n for n, b in enumerate(others)}


class Remembered(dict):
    """A bounded memory of a function's results, in two generations: what is asked for again stays."""

    def __init__(self, function, most: int) -> None:
        self.function, self.most, self.older = function, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.function(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, remembering those of pre-tokens.

    Byte-level BPE never merges across pre-tokens, so a text's ids are its pre-tokens' ids in order.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.by_piece = (
            spec["normalizer"] is None
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and BYTE_LEVEL.items() <= (spec["pre_tokenizer"] or {}).items()
        )
        # An added token is cut out of a text before anything else; such texts go through the library whole.
        added = [re.escape(token["content"]) for token in spec["added_tokens"]]
        self.added = re.compile("|".join(added) or r"(?!)").search
        self.pieces = re.compile(_pre_tokens()).findall
        self.safe = re.compile(f"[{re.escape(SAFE)}]*").fullmatch
        self.letters = _byte_letters()
        self.of_piece = Remembered(self._piece, REMEMBERED)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        written = piece.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.tokenizer.model.tokenize(written)], dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.by_piece and self.safe(text) and not self.added(text):
            return b"".join(map(self.of_piece.__getitem__, self.pieces(text)))
        return self._whole(text)


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """The worker's encoder, kept with what it remembers from task to task."""
    return Encoder(path)


class Rule(NamedTuple):
    """Documents of one length with ranks from ``first`` on go to bins from ``bin`` on, ``each`` per bin, at ``offset``."""

    length: int
    first: int
    bin: int
    each: int
    offset: int


class CapacityTree:
    """Segment tree over remaining capacities: which ones have an open bin."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, capacity: int, there: bool) -> None:
        at = capacity + self.size
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open bin that is ``least`` or more, in logarithmic time."""
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(lengths: dict[int, int], capacity: int) -> list[Rule]:
    """Best-fit decreasing over a histogram of lengths (1 to ``capacity``).

    Documents of one length are alike and so are bins with one remaining capacity, so whole runs of documents are
    placed by one look-up in the tree. The packing is that of placing each document by itself in the tightest open
    bin, while work and memory depend on the number of lengths, not of documents.
    """
    tree, bins, rules = CapacityTree(capacity), 0, []
    still: dict[int, list[tuple[int, int]]] = {}

    def push(space: int, first: int, count: int) -> None:
        if count and space:
            still.setdefault(space, []).append((first, count))
            tree.set(space, True)

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            space = tree.tightest(length)
            if space is None:
                space, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = still[space].pop()
                tree.set(space, bool(still[space]))
            each = space // length
            full = min(count, left // each)
            for at, n, per in ((first, full, each), (first + full, int(full < count), min(left - full * each, each))):
                if n and per:
                    rules.append(Rule(length, rank, at, per, capacity - space))
                    push(space - per * length, at, n)
                    rank, left, first, count = rank + n * per, left - n * per, at + n, count - n
            push(space, first, count)
    return rules


def tokenized(
    docs: DataFrame, path: str, end_id: int, capacity: int, text: str = "text", key: str = "doc_id", with_ids: bool = False
) -> DataFrame:
    """Pieces of documents: key, piece, start, length, ids_crc32 and, if asked for, ``ids`` (little-endian uint32).

    A document is the ids of its text and the end id. One longer than ``capacity`` is cut from its end into full
    pieces, so only its first piece may be shorter.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = encoder_of(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for name, value in zip(batch["key"], batch["text"]):
                ids = memoryview(encoder.ids(value) + end)
                total = len(ids) // 4
                start, stop = 0, total % capacity or capacity
                for piece in range(-(-total // capacity)):
                    part = ids[4 * start : 4 * stop]
                    rows.append((name, piece, start, stop - start, zlib.crc32(part), *([bytes(part)] if with_ids else [])))
                    start, stop = stop, stop + capacity
            out = pd.DataFrame(rows, columns=["key", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
            out["key"] = pd.array(out["key"], dtype="object")
            yield out

    common.bounded_batches(docs.sparkSession)
    rows = common.spread(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInPandas(run, schema).withColumnRenamed("key", key)


def pack(pieces: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``capacity`` tokens; other columns are kept. Columns of
    these names are replaced. Repeated pieces are packed each by itself.

    Only the histogram of lengths (``capacity`` rows at most) reaches the driver, and only the rules made of it are
    broadcast; their number depends on the lengths that occur. A piece's rank among those of its length is the number
    in the earlier parts plus its place in its own part, so one very common length is dealt over all parts.
    """
    spark = pieces.sparkSession
    pieces = common.written(pieces, "pieces")
    parts = 4 * common.wide(pieces)
    part, rank, before = (common.fresh(pieces, c) for c in ("part", "rank", "before"))
    dealt = pieces.withColumn(part, F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(part, "length").agg(F.count("*").alias(before))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum(before).alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, "length", F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    own = Window.partitionBy(part, "length").orderBy(key, "piece", "ids_crc32")
    ranked = dealt.withColumn(rank, F.row_number().over(own) - 1).join(offsets, [part, "length"])

    by_length: dict[int, list[Rule]] = {}
    for rule in best_fit_decreasing(lengths, capacity):
        by_length.setdefault(rule.length, []).append(rule)
    rules = spark.sparkContext.broadcast({n: np.array(r, dtype="int64") for n, r in by_length.items()})

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), dtype="int64")
        for n, at in length.groupby(length).indices.items():
            table, ranks = rules.value[int(n)], number.to_numpy()[at]
            rule = table[np.searchsorted(table[:, 1], ranks, side="right") - 1]
            step, place = np.divmod(ranks - rule[:, 1], rule[:, 3])
            out[at, 0], out[at, 1] = rule[:, 2] + step, rule[:, 4] + place * n
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    at = common.fresh(pieces, "at")
    placed = ranked.withColumn(at, place(F.col("length"), (F.col(rank) + F.col(before)).cast("long")))
    kept = [c for c in pieces.columns if c.lower() not in {"sequence_id", "offset"}]
    return placed.select(*kept, f"{at}.sequence_id", f"{at}.offset")
