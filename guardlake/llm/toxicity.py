"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake.llm import common

WORDS = re.compile(r"\w+")
# Words this long or longer also count by their beginnings of these lengths, which inflected and joined forms share.
STEMS = range(3, 10)
# Places that terms are hashed to: the size of a model, whatever the texts.
PLACES = 1 << 20
# Words whose terms a worker remembers before it starts afresh.
REMEMBERED = 200_000


def of_word(word: str) -> list[int]:
    """Places of a word and of its proper beginnings, which are told apart from whole words by a star."""
    names = [word, *(f"{word[:n]}*" for n in STEMS if n < len(word))]
    return [zlib.crc32(name.encode()) % PLACES for name in names]


def terms(text: str) -> set[int]:
    """Places of a text's distinct terms: lower-cased words and their beginnings."""
    return {place for word in set(WORDS.findall(text.lower())) for place in of_word(word)}


class Machine(NamedTuple):
    """``bias + sum w[i] + sum over pairs <v[i], v[j]>`` over the places of a text's terms. Places that no sampled text
    has weigh nothing."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def scorer(self):
        seen: dict[str, list[int]] = {}

        def score(text: str) -> float:
            if len(seen) > REMEMBERED:
                seen.clear()
            found = set()
            for word in set(WORDS.findall(text.lower())):
                at = seen.get(word)
                if at is None:
                    at = seen[word] = of_word(word)
                found.update(at)
            return self.value(sorted(found))

        return score

    def value(self, at: list[int]) -> float:
        v = self.v[at].astype("f8")
        pairs = 0.5 * float((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(_sigmoid(self.bias + float(self.w[at].astype("f8").sum()) + pairs))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _values(rows: list[np.ndarray], labels: np.ndarray, n: int, least: float) -> np.ndarray:
    """How much a term counts when the machine learns, from ``least`` to 1: more, the further its share of label 1 lies
    off the average, in standard errors of five rows more than it has. None is left out, so pairs can still tell."""
    count, found, share = np.zeros(n), np.zeros(n), float(np.clip(labels.mean(), 1e-4, 1 - 1e-4))
    for row, label in zip(rows, labels):
        count[row] += 1
        found[row] += label
    off = (found - count * share) ** 2 / ((count + 5) * share * (1 - share))
    return least + (1 - least) * np.minimum(off / 25, 1)


def fit(
    rows: list[np.ndarray], labels: np.ndarray, factors: int = 4, epochs: int = 15, batch: int = 256, rate: float = 0.2,
    pairs_rate: float = 0.05, l1: float = 3e-4, decay: float = 2e-4, group: float = 1e-3, least: float = 0.1,
    least_pairs: float = 0.5, seed: int = 7,
) -> Machine:
    """Logistic loss, mini-batches in a fixed shuffled order, Adagrad steps, weights drawn towards zero.

    ``rows`` are sorted places without repetition. Terms that say little by themselves count ``least`` in the sum and
    ``least_pairs`` in pairs while the machine learns, so that the many of them do not drown the few that matter."""
    # A row without terms has one that weighs nothing in the end.
    there = np.zeros(PLACES + 1, dtype=bool)
    there[PLACES] = True
    for row in rows:
        there[row] = True
    places, number = np.flatnonzero(there), np.cumsum(there, dtype=np.int32) - 1
    rows = [number[x] if len(x) else number[-1:] for x in rows]
    rng = np.random.default_rng(seed)
    n = len(places)
    value, paired = _values(rows, labels, n, least), _values(rows, labels, n, least_pairs)
    w, v = np.zeros(n), rng.normal(0, 0.01, (n, factors))
    w[-1], v[-1] = 0, 0
    mean = float(np.clip(labels.mean(), 1e-4, 1 - 1e-4))
    bias, gw, gv, gb = float(np.log(mean / (1 - mean))), np.full(n, 1e-3), np.full(v.shape, 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            some = order[start : start + batch]
            sizes = np.array([len(rows[i]) for i in some])
            idx = np.concatenate([rows[i] for i in some])
            starts = np.cumsum(sizes) - sizes
            x = value[idx]
            y = paired[idx][:, None]
            vi = v[idx] * y
            sums = np.add.reduceat(vi, starts)
            pairs = 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((vi**2).sum(axis=1), starts))
            error = (_sigmoid(bias + np.add.reduceat(w[idx] * x, starts) + pairs) - labels[some]) / len(some)
            each = np.repeat(error, sizes)
            used, back = np.unique(idx, return_inverse=True)
            dw = np.bincount(back, each * x, len(used))
            moves = each[:, None] * y * (np.repeat(sums, sizes, axis=0) - vi)
            dv = np.stack([np.bincount(back, moves[:, f], len(used)) for f in range(factors)], axis=1) + decay * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += error.sum() ** 2
            step = rate / np.sqrt(gw[used])
            moved = w[used] - step * dw
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            pace = pairs_rate / np.sqrt(gv[used])
            moved = v[used] - pace * dv
            # The factors of a term shrink together: they vanish unless its pairs keep telling something.
            length = np.sqrt((moved**2).sum(axis=1, keepdims=True)) + 1e-12
            v[used] = moved * np.maximum(1 - pace.mean(axis=1, keepdims=True) * group / length, 0)
            bias -= 0.05 * error.sum() / np.sqrt(gb)
            w[-1], v[-1] = 0, 0
    whole_w, whole_v = np.zeros(PLACES, "f4"), np.zeros((PLACES, factors), "f4")
    whole_w[places[:-1]], whole_v[places[:-1]] = (w * value)[:-1], (v * paired[:, None])[:-1]
    return Machine(bias, whole_w, whole_v)


def train(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 6_000, text: str = "text", key: str = "doc_id", label: str = "toxic",
    held_out: int = 0,
) -> Machine | None:
    """Fit on labelled documents whose crc32 of the key does not leave ``held_out`` by 5; None without any.

    At most ``sample_rows`` of them are used, chosen by a hash of the key; all of them if there are no more. All terms
    of their whole texts count; hashing to ``PLACES`` places bounds the model, so no vocabulary is needed. The driver
    holds only the places of this bounded sample. Rows with the same terms and label count once, so that copies do not
    outvote the rest. A key with several labels takes the highest; null labels and keys are not used.
    """
    common.bounded_batches(docs.sparkSession)
    known = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~common.held_out(F.col(key), held_out))
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(label).cast("int").alias("y"))
    )
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(sample_rows)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "h": [np.array(sorted(terms(t)), "<i4").tobytes() for t in batch["text"]]})

    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "key").mapInPandas(hashed, "y int, h binary")
    rows = common.written(found.withColumn("id", F.xxhash64("y", "h")).dropDuplicates(["id"]), "terms")
    sample = rows.orderBy("id").select("y", "h").collect()
    if not sample:
        return None
    return fit([np.frombuffer(r["h"], "<i4") for r in sample], np.array([r["y"] for r in sample], dtype="float64"))


def score(docs: DataFrame, model: Machine | None, text: str = "text", column: str = "score") -> DataFrame:
    """Add a score from 0 to 1 to every row, from its whole text; null texts count as empty, and repeated rows score
    alike. Without a model all scores are 0. A column of the same name is replaced."""
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    common.bounded_batches(docs.sparkSession)
    # Bounded by the number of places: 20 MB.
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = held.value.scorer()
        for batch in texts:
            yield batch.map(of).astype("float64")

    return docs.withColumn(column, scored(F.coalesce(F.col(text), F.lit(""))))
