"""Language-model scores by prediction by partial matching over bytes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.llm import common

# Symbols of nine bits each, 0 being none: the bytes, the end of a text, and its start, which only contexts hold.
# Six symbols, a context of five and what follows it, fit a long.
BITS, BYTE, END, START = 9, 1, 257, 258
ALPHABET = 257
ORDER = 5
# Characters of text whose documents are counted and scored together, and bytes worked on at once.
BLOCK_CHARS, SLICE = 16 << 20, 1 << 19
# Rows of a block's words and grams that Spark is handed at once.
SENT = 1 << 16
# Grams are written in ascending order within a block, so their differences are small.
SMALL = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}


def tokens(text: bytes) -> list[bytes]:
    """Words of a lower-cased text, and an empty one for its end."""
    return [*text.split(), b""]


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts and their ends, itself with up to ``order`` symbols before it; and where each text
    begins. Contexts begin with the start of the text."""
    sizes = np.fromiter(map(len, texts), "i8", len(texts))
    begins = np.cumsum(sizes + 2) - (sizes + 2)
    symbols = np.full(int((sizes + 2).sum()), START, "i8")
    depth = np.arange(len(symbols)) - np.repeat(begins, sizes + 2)
    symbols[(depth > 0) & (depth <= np.repeat(sizes, sizes + 2))] = np.frombuffer(b"".join(texts), "u1").astype("i8") + BYTE
    symbols[begins + sizes + 1] = END
    out = symbols.copy()
    for back in range(1, min(order, len(symbols) - 1) + 1):
        out[back:] += np.where(depth[back:] >= back, symbols[:-back], 0) << (BITS * back)
    return out[depth > 0], begins - np.arange(len(texts))


def _suffix(gram: Column, symbols: Column) -> Column:
    """The last so many symbols, one at least."""
    return gram.bitwiseAND(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - BITS * symbols))


def _length(gram: Column) -> Column:
    """How many symbols a gram has: none of them is 0."""
    return 1 + sum(((gram >= 1 << BITS * n).cast("int") for n in range(1, 64 // BITS)), F.lit(0))


def trie(longest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (gram, n) of the context trie and its nodes, from (gram, n) of the training text.

    A gram is a context and the symbol that follows it; every shorter context counts what the longer ones count. Nodes
    are (ctx, total, kinds, cover): occurrences, different symbols, and how often these symbols occur after the next
    shorter context, which is what exclusion takes away there.
    """
    suffixes = longest.select(F.explode(F.sequence(F.lit(1), _length(F.col("gram")))).alias("k"), "gram", "n")
    edges = suffixes.groupBy(_suffix(F.col("gram"), F.col("k")).alias("gram")).agg(F.sum("n").alias("n"))
    edges = common.written(edges, "edges", **SMALL)
    shorter = edges.select(F.col("gram").alias("short"), F.col("n").alias("there"))
    short = _suffix(F.col("gram"), _length(F.col("gram")) - 1)
    nodes = (
        edges.withColumn("short", F.when(F.col("gram") >= 1 << BITS, short))
        .join(shorter, "short", "left")
        .groupBy(F.shiftright("gram", BITS).alias("ctx"))
        .agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.coalesce(F.sum("there"), F.lit(0)).alias("cover"))
    )
    return edges, common.written(nodes, "nodes", **SMALL)


def costs(wanted: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gram, cost): log10 of the probability of each wanted gram's last symbol after its context.

    Escape method D with exclusion: of twice the count of what a seen context holds, each symbol gives one to the
    escape. Symbols that a longer context has refused are taken out of the shorter ones. A context with nothing else
    left escapes free of cost. Below the empty context all symbols left are alike.
    """
    seen = (
        wanted.join(edges, "gram")
        .join(nodes, F.shiftright("gram", BITS) == F.col("ctx"))
        .select("gram", F.log10((2 * F.col("n") - 1) / (2 * F.col("total"))).alias("cost"))
    )
    unseen = wanted.join(edges, "gram", "left_anti")
    levels = unseen.select("gram", F.explode(F.sequence(F.lit(1), _length(F.col("gram")))).alias("k"))
    levels = levels.withColumn("g", _suffix(F.col("gram"), F.col("k"))).withColumn("ctx", F.shiftright("g", BITS))
    known = (
        levels.join(nodes, "ctx", "left")
        .join(edges.withColumnRenamed("gram", "g"), "g", "left")
        .select("gram", F.struct((-F.col("k")).alias("k"), "n", "total", "kinds", "cover").alias("level"))
        .groupBy("gram")
        .agg(F.sort_array(F.collect_list("level")).alias("levels"))
    )
    none = F.lit(0).cast("long")
    start = F.struct(F.lit(0.0).alias("cost"), none.alias("cover"), none.alias("kinds"), F.lit(False).alias("done"))

    def step(state: Column, level: Column) -> Column:
        kinds = level["kinds"] - state["kinds"]
        idle = state["done"] | level["total"].isNull()
        gain = F.log10(F.coalesce(2 * level["n"] - 1, kinds) / (2 * (level["total"] - state["cover"])))
        return F.struct(
            F.when(idle | (kinds == 0), state["cost"]).otherwise(state["cost"] + gain).alias("cost"),
            F.when(idle, state["cover"]).otherwise(level["cover"]).alias("cover"),
            F.when(idle, state["kinds"]).otherwise(level["kinds"]).alias("kinds"),
            (state["done"] | level["n"].isNotNull()).alias("done"),
        )

    def finish(state: Column) -> Column:
        return F.when(state["done"], state["cost"]).otherwise(state["cost"] - F.log10(F.lit(ALPHABET) - state["kinds"]))

    return seen.unionByName(known.select("gram", F.aggregate("levels", start, step, finish).alias("cost")))


class Prices:
    """Costs of grams, looked up for many at once: a table of hashed places first, halving for what it misses."""

    def __init__(self, kinds: np.ndarray, cost: np.ndarray) -> None:
        by = np.argsort(kinds)
        self.kinds, self.cost = kinds[by], cost[by]
        self.shift = np.uint64(64 - (4 * max(len(kinds), 1)).bit_length())
        self.places = np.zeros(1 << int(64 - self.shift), "i4")
        self.places[self._place(self.kinds)] = np.arange(len(kinds))

    def _place(self, wanted: np.ndarray) -> np.ndarray:
        return (wanted.view("u8") * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def of(self, wanted: np.ndarray) -> np.ndarray:
        at = self.places[self._place(wanted)]
        missed = np.flatnonzero(self.kinds[at] != wanted)
        at[missed] = np.searchsorted(self.kinds, wanted[missed])
        return self.cost[at]


def _slices(packed: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Unpacked texts, some at a time, with the number of the first one."""
    unpack, some, first, size = zstandard.ZstdDecompressor().decompress, [], 0, 0
    for i, one in enumerate(packed):
        some.append(unpack(one))
        size += len(some[-1])
        if size >= SLICE or i + 1 == len(packed):
            yield first, some
            some, first, size = [], i + 1, 0


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    kinds, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return kinds, np.bincount(back, np.concatenate([p[1] for p in parts]), len(kinds)).astype("i8")


def _counter(order: int):
    """What a block of documents holds: its words and its grams, each with its count in training documents."""

    def count(batch: pa.Table) -> pa.Table:
        held = batch["held_out"].to_pylist()
        words: Counter = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for first, texts in _slices(batch["packed"].to_pylist()):
            for i, text in enumerate(texts, first):
                words.update(dict.fromkeys(tokens(text), 0) if held[i] else tokens(text))
            for out in (False, True):
                own = [t for i, t in enumerate(texts, first) if held[i] == out]
                if own:
                    kinds, n = np.unique(grams(own, order)[0], return_counts=True)
                    parts.append((kinds, np.zeros_like(n) if out else n))
            if len(parts) >= 8:
                parts = [_merged(parts)]
        kinds, n = _merged(parts)
        total = len(words) + len(kinds)
        found = pa.table(
            {
                "block": pa.array(np.full(total, batch["block"][0].as_py(), "i4")),
                "word": pa.concat_arrays([pa.array(words.keys(), pa.binary()), pa.nulls(len(kinds), pa.binary())]),
                "gram": pa.concat_arrays([pa.nulls(len(words), pa.int64()), pa.array(kinds)]),
                "n": pa.concat_arrays([pa.array(words.values(), pa.int64()), pa.array(n)]),
            }
        )
        return pa.Table.from_batches(found.to_batches(max_chunksize=SENT))

    return count


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", held_out: int = 1, order: int = ORDER) -> DataFrame:
    """Score every text, by a model of those whose crc32 of the key does not leave ``held_out`` by 5.

    A-Z are lower-cased; a text is its words, cut at the six ASCII spaces, with single spaces between them, and an
    end. ``score`` is the log10 probability of its bytes and end by prediction by partial matching with the trained
    counts, ``base_score`` that of its words and end one by one, half a count added to each and to one unknown word.
    Null texts count as empty; a null key is not held out; every row of a repeated key counts.

    Documents are dealt into blocks by a hash. A block passes on its different words and grams with their counts, and
    gets the total counts and the costs of just these back, so nothing that grows with the corpus is broadcast.
    """
    common.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("key", "text"), F.lit(common.divided(chars, BLOCK_CHARS))).cast("int")
    rows = common.spread(rows.select("key", common.held_out(F.col("key"), held_out).alias("held_out"), block.alias("block"), "text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(1).compress
        for batch in batches:
            texts = [compress(b" ".join(t.encode().lower().split())) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["held_out"], batch["block"], pa.array(texts, pa.binary())], ["key", "held_out", "block", "packed"]
            )

    kind = docs.schema[key].dataType.simpleString()
    packed = rows.mapInArrow(pack, f"key {kind}, held_out boolean, block int, packed binary")
    found = common.written(
        packed.groupBy("block").applyInArrow(_counter(order), "block int, word binary, gram long, n long"), "words-and-grams", **SMALL
    )
    words = found.where("word is not null").select("block", "word", "n")
    counts = common.written(words.groupBy("word").agg(F.sum("n").alias("c")), "words", **SMALL)
    total, different = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    found_grams = found.where("gram is not null").select("block", "gram", "n")
    totals = common.written(found_grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams", **SMALL)
    edges, nodes = trie(totals.where("n > 0"))
    priced = common.written(costs(totals.select("gram"), edges, nodes), "costs", **SMALL)
    known = (
        words.select("block", "word")
        .join(counts, "word")
        .select("block", "word", "c", F.lit(None).cast("long").alias("gram"), F.lit(None).cast("double").alias("cost"))
        .union(
            found_grams.select("block", "gram")
            .join(priced, "gram")
            .select("block", F.lit(None).cast("binary"), F.lit(None).cast("long"), "gram", "cost")
        )
    )
    rest = total + 0.5 * (different + 1)

    def rate(block: tuple, batch: pa.Table, own: pa.Table) -> pa.Table:
        is_word = own["word"].is_valid()
        own_words, own_grams = own.select(["word", "c"]).filter(is_word), own.select(["gram", "cost"]).filter(own["gram"].is_valid())
        c = own_words["c"].to_numpy()
        base = np.log10((c + 0.5) / rest)
        number = dict(zip(own_words["word"].to_pylist(), range(len(c))))
        prices = Prices(own_grams["gram"].to_numpy(), own_grams["cost"].to_numpy())
        del own, own_words, own_grams
        n, n_known, bases, scores = [], [], [], []
        for _, texts in _slices(batch["packed"].to_pylist()):
            for text in texts:
                at = np.array([number[w] for w in tokens(text)])
                n.append(len(at))
                n_known.append(int((c[at] > 0).sum()))
                bases.append(float(base[at].sum()))
            wanted, begins = grams(texts, order)
            scores.extend(np.add.reduceat(prices.of(wanted), begins).tolist())
        return pa.table(
            {
                "key": batch["key"],
                "held_out": batch["held_out"],
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([total] * len(n), pa.int64()),
                "base_score": pa.array(bases, pa.float64()),
                "score": pa.array(scores, pa.float64()),
            }
        )

    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(rate, schema).withColumnRenamed("key", key)
