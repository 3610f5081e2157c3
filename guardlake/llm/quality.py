"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.llm import common

STATISTICS = [
    "log_chars", "log_words", "letters", "capitals", "digits", "marks", "blanks", "distinct_words", "distinct_lines",
    "log_word_length", "log_line_words", "compressed", "words_ending_in_marks", "commonest_word",
]
# Random features are whole multiples of 1 / UNIT, so that sums of their products are exact in any order.
UNIT = 1 << 15
# Statistics count in multiples of 1 / GRAIN where their averages are taken, for the same reason.
GRAIN = 1 << 20
# Raw scores fall into this many bins from LOW to HIGH for the calibration; labelled rows of one task of the fit.
BINS, LOW, HIGH, TASK_ROWS = 4096, -0.5, 1.5, 50_000
FOLDS = 3


@cache
def kinds() -> np.ndarray:
    """Per code point: 0 for marks, 1 small or caseless letter, 2 capital letter, 3 digit, 4 blank."""
    out = np.zeros(0x110000, "u1")
    for code in range(0x110000):
        c = chr(code)
        out[code] = 4 if c.isspace() else 3 if c.isdigit() else 0 if not c.isalpha() else 2 if c.isupper() else 1
    return out


def statistics(text: str | None) -> list[float]:
    """The numbers of ``STATISTICS`` for a whole text; shares of nothing are 0, null counts as empty."""
    text = text or ""
    n, words, lines = len(text), text.split(), text.split("\n")
    # Lone surrogates count as marks.
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    marks, small, capitals, digits, blanks = np.bincount(kinds()[codes], minlength=5).tolist()
    letters, raw, counts = small + capitals, text.encode("utf-8", "surrogatepass"), Counter(words)

    def share(part: float, whole: float) -> float:
        return part / whole if whole else 0.0

    return [
        math.log1p(n),
        math.log1p(len(words)),
        share(letters, n),
        share(capitals, letters),
        share(digits, n),
        share(marks, n),
        share(blanks, n),
        share(len(counts), len(words)),
        share(len(set(lines)), len(lines)),
        math.log1p(share(letters, len(words))),
        math.log1p(len(words) / len(lines)),
        share(len(zlib.compress(raw, 1)) if raw else 0, len(raw)),
        share(sum(count for word, count in counts.items() if word[-1] in ".!?,"), len(words)),
        share(max(counts.values(), default=0), len(words)),
    ]


class Features(NamedTuple):
    """``cos(W z + b)`` of standardised statistics z: their inner products approximate exp(-width^2 |z - z'|^2 / 2)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Whole numbers, in units of 1 / UNIT; the first one is constant."""
        z = np.clip((rows - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.full((len(rows), 1), UNIT), np.rint(UNIT * np.cos(z @ self.weights + self.shift))], axis=1)


class Model(NamedTuple):
    features: Features
    ridge: np.ndarray
    # Raw scores and calibrated ones; between them the line is straight, beyond them it is level.
    steps: tuple[np.ndarray, np.ndarray]

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features.of(rows) @ self.ridge, *self.steps), 0.0, 1.0)


def isotonic(at: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean places and mean labels of the blocks of the best rising step function."""
    blocks: list[list[float]] = []
    for x, count, y in zip(at * n, n, total):
        blocks.append([float(x), float(count), float(y)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([x / c for x, c, _ in blocks]), np.array([y / c for _, c, y in blocks])


def measured(docs: DataFrame, text: str = "text", column: str = "statistics") -> DataFrame:
    """Add the statistics of every whole text, as an array of doubles; a column of the same name is replaced."""
    common.bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    return docs.withColumn(column, of(F.coalesce(F.col(text), F.lit(""))))


def _standard(rows: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every statistic over all rows, from exact sums."""
    whole = [F.round(F.get(column, i) * GRAIN).cast("decimal(38,0)") for i in range(len(STATISTICS))]
    sums = rows.agg(F.count(column), *[F.sum(x) for x in whole], *[F.sum((x * x).cast("decimal(38,0)")) for x in whole]).first()
    n, size = max(sums[0], 1), len(STATISTICS)
    first = np.array([float(x or 0) for x in sums[1 : 1 + size]]) / n / GRAIN
    second = np.array([float(x or 0) for x in sums[1 + size :]]) / n / GRAIN**2
    return first, np.sqrt(np.maximum(second - first**2, 0)) + 1e-6


def train(
    rows: DataFrame, labels: DataFrame, column: str = "statistics", key: str = "doc_id", label: str = "quality", held_out: int = 0,
    size: int = 256, width: float = 0.15, penalty: float = 0.1, seed: int = 11,
) -> Model | None:
    """Fit on all labelled rows of ``measured`` whose crc32 of the key does not leave ``held_out`` by 5; None without any.

    Statistics are standardised over all rows. Every task of the labelled rows adds up its normal equations, one set a
    fold, and only these sums (``size`` squared, whatever the number of rows) reach the driver, which solves them with
    ``penalty`` on every weight but the constant. Sums of up to 2^32 rows are exact, so order and partitions do not
    matter. The calibration learns from scores of the models that did not see the row's fold, in 4,096 bins. Rows with
    the same statistics and label count once, so that copies neither outvote the rest nor meet themselves across
    folds. A key with several labels takes the highest; null labels and keys are not used. Labels over 0 count as 1.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~common.held_out(F.col(key), held_out))
        .groupBy(F.col(key).alias("key"))
        .agg((F.max(label) > 0).cast("int").alias("y"))
    )
    measures = rows.select(F.col(key).alias("key"), F.col(column).alias("x")).where("x is not null")
    # The row of a rare key that is labelled often, or of many copies under one key, is one row again here.
    found = measures.join(known, "key").select("x", "y").distinct()
    found = common.written(found.withColumn("fold", F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int")), "labelled")
    n = found.count()
    if not n:
        return None
    rng = np.random.default_rng(seed)
    features = Features(
        *_standard(rows, column), rng.normal(0, width, (len(STATISTICS), size)), rng.uniform(0, 2 * math.pi, size)
    )
    spark = rows.sparkSession
    # A few matrices of fixed size.
    held = spark.sparkContext.broadcast(features)
    found = found.coalesce(common.divided(n, TASK_ROWS))

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((FOLDS, size + 1, size + 2), "i8")
        for batch in batches:
            some = held.value.of(np.stack(batch["x"].to_numpy()))
            right = np.concatenate([some, batch["y"].to_numpy("f8")[:, None]], axis=1)
            for fold in range(FOLDS):
                of = batch["fold"].to_numpy() == fold
                # Below 2^53 for the rows of a batch, so exact in doubles.
                sums[fold] += (some[of].T @ right[of]).astype("i8")
        for fold in range(FOLDS):
            yield pd.DataFrame({"fold": fold, "line": range(size + 1), "sums": [line.tobytes() for line in sums[fold]]})

    def total(lines: pd.DataFrame) -> pd.DataFrame:
        first = lines.iloc[[0]].copy()
        first["sums"] = [np.sum([np.frombuffer(x, "i8") for x in lines["sums"]], axis=0).tobytes()]
        return first

    shape = "fold int, line int, sums binary"
    lines = found.mapInPandas(added, shape).groupBy("fold", "line").applyInPandas(total, shape).collect()
    sums = np.zeros((FOLDS, size + 1, size + 2))
    for line in lines:
        sums[line["fold"], line["line"]] = np.frombuffer(line["sums"], "i8")

    def solved(parts: np.ndarray) -> np.ndarray:
        left, right = parts[:, :-1] / UNIT**2, parts[:, -1] / UNIT
        weights = np.full(size + 1, penalty * size / 2)
        weights[0] = 1e-9
        return np.linalg.lstsq(left + np.diag(weights), right, rcond=None)[0] / UNIT

    apart = np.stack([solved(sums.sum(axis=0) - sums[fold]) for fold in range(FOLDS)])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, BINS), "i8")
        for batch in batches:
            raw = np.einsum("ij,ij->i", held.value.of(np.stack(batch["x"].to_numpy())), apart[batch["fold"].to_numpy()])
            bins = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype("i8")
            y = batch["y"].to_numpy()
            counts += np.stack([np.bincount(bins[y == side], minlength=BINS) for side in (0, 1)])
        some = np.flatnonzero(counts.sum(axis=0))
        yield pd.DataFrame({"bin": some, "n": counts[:, some].sum(axis=0), "ones": counts[1, some]})

    bins = found.mapInPandas(binned, "bin int, n long, ones long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    steps = np.array([tuple(row) for row in bins.orderBy("bin").collect()], "f8")
    at = LOW + (steps[:, 0] + 0.5) * (HIGH - LOW) / BINS
    return Model(features, solved(sums.sum(axis=0)), isotonic(at, steps[:, 1], steps[:, 2]))


def score(rows: DataFrame, model: Model | None, measures: str | Column = "statistics", column: str = "score") -> DataFrame:
    """Add a score from 0 to 1 to every row of ``measured``. Without a model all scores are 0. Rows without statistics
    score like empty texts. A column of the same name is replaced."""
    if model is None:
        return rows.withColumn(column, F.lit(0.0))
    held = rows.sparkSession.sparkContext.broadcast(model)
    nothing = F.array(*[F.lit(x) for x in statistics("")])

    @F.pandas_udf("double")
    def scored(some: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(np.stack(some.to_numpy())) if len(some) else [], dtype="f8")

    return rows.withColumn(column, scored(F.coalesce(F.col(measures) if isinstance(measures, str) else measures, nothing)))
