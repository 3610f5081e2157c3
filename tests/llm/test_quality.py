"""The quality classifier against a plain version, and on held-out labels."""

import math
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from guardlake.llm import common, quality, queries
from tests.llm.helpers import frame, prose, rows_of


def plain_statistics(text):
    text = text or ""
    letters = [c for c in text if c.isalpha() and not c.isspace() and not c.isdigit()]
    digits = [c for c in text if c.isdigit() and not c.isspace()]
    blanks, words, lines = [c for c in text if c.isspace()], text.split(), text.split("\n")
    n, w = max(len(text), 1), max(len(words), 1)
    return [
        math.log(1 + len(text)), math.log(1 + len(words)), len(letters) / n,
        sum(c.isupper() for c in letters) / max(len(letters), 1), len(digits) / n,
        (len(text) - len(letters) - len(digits) - len(blanks)) / n, len(blanks) / n,
        len(set(words)) / w, len(set(lines)) / len(lines), math.log(1 + len(letters) / w),
        math.log(1 + len(words) / len(lines)), len(zlib.compress(text.encode(), 1)) / max(len(text.encode()), 1) if text else 0,
        sum(x[-1] in ".!?," for x in words) / w, max([words.count(x) for x in words], default=0) / w,
    ]


@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])))
@settings(max_examples=200, deadline=None)
def test_statistics_by_definition(text):
    assert np.allclose(quality.statistics(text), plain_statistics(text))


def test_statistics_of_awkward_texts():
    assert quality.statistics(None) == quality.statistics("")
    assert len(quality.statistics("")) == len(quality.STATISTICS)
    long = prose(1, 2000) + "\n" + "word " * 500_000
    assert math.isclose(quality.statistics(long)[-1], 500_000 / 502_000)
    assert quality.statistics("Aa1 .\ud800")[0] == math.log1p(6)


@given(st.lists(st.tuples(st.integers(1, 5), st.integers(0, 5)), min_size=1, max_size=12))
@settings(max_examples=100, deadline=None)
def test_isotonic_by_definition(cells):
    n = np.array([a for a, _ in cells], "f8")
    total = np.array([min(a, b) for a, b in cells], "f8")
    at, level = quality.isotonic(np.arange(len(cells), dtype="f8"), n, total)
    assert (np.diff(level) > 0).all() and (np.diff(at) > 0).all()
    # The best rising steps: max over starts of min over ends of the mean label.
    want = [
        max(min(total[i : j + 1].sum() / n[i : j + 1].sum() for j in range(x, len(cells))) for i in range(x + 1))
        for x in range(len(cells))
    ]
    assert np.allclose(sorted(set(np.round(want, 9))), np.round(level, 9))


def plain_model(rows, labels, size=256, width=0.15, penalty=0.1, seed=11):
    """The same model from all rows at once, in plain matrices."""
    x = np.array([s for _, s in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    rng = np.random.default_rng(seed)
    weights, shift = rng.normal(0, width, (x.shape[1], size)), rng.uniform(0, 2 * math.pi, size)

    def of(s):
        return np.concatenate([np.ones((len(s), 1)), np.cos(np.clip((s - mean) / scale, -8, 8) @ weights + shift)], axis=1)

    known = {(tuple(s), labels[i]) for i, s in rows if i in labels and zlib.crc32(str(i).encode()) % 5}
    some, y = np.array([s for s, _ in known]), np.array([v for _, v in known], "f8")
    p = of(some)
    ridge = np.diag([1e-9] + [penalty * size / 2] * size)
    return of(x) @ np.linalg.solve(p.T @ p + ridge, p.T @ y)


def test_scores_by_brute_force(spark, sf):
    docs, labels = common.load(spark, sf, "documents"), common.load(spark, sf, "labels")
    rows = common.written(quality.measured(docs).select("doc_id", "statistics"), "statistics")
    model = quality.train(rows, labels)
    given_rows = [(r.doc_id, plain_statistics(r.text)) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    raw = plain_model(given_rows, {r.doc_id: r.quality for r in labels.collect()})
    want = np.clip(np.interp(raw, *model.steps), 0, 1)
    got = [r.score for r in quality.score(rows, model).orderBy("doc_id").collect()]
    assert np.allclose(got, want, atol=2e-3)
    assert (np.diff(model.steps[1]) > 0).all()
    # Partitions and order of the rows do not matter.
    again = quality.train(rows.repartition(7, F.rand(3)), labels.repartition(5))
    assert np.array_equal(model.ridge, again.ridge) and np.array_equal(model.steps[0], again.steps[0])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op11_quality(spark, sf).join(common.load(spark, sf, "labels"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in out)
    assert len(out) > 50 and right >= 0.97 * len(out)
    ones, zeros = [r.score for r in out if r.quality], [r.score for r in out if not r.quality]
    auc = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert auc >= 0.98


def test_awkward_rows(spark):
    docs = frame(spark)
    rows = common.written(quality.measured(docs), "statistics")
    assert rows.count() == docs.count()
    labels = spark.createDataFrame(
        [(i, i % 2, "en") for i in range(1, 30)] + [(1, None, "x"), (None, 1, "x"), (6, 1, "x")], "doc_id long, quality int, lang string"
    )
    out = quality.score(rows, quality.train(rows, labels))
    scores = {(r.doc_id, r.text): r.score for r in out.collect()}
    assert out.count() == docs.count() and all(0 <= s <= 1 for s in scores.values())
    assert scores[6, ""] == scores[7, None] and scores[1, prose(1)] == scores[2, prose(1)]
    assert quality.train(rows, labels.limit(0)) is None
    assert {r.score for r in quality.score(rows, None).collect()} == {0.0}
    one = quality.train(rows, labels.withColumn("quality", F.lit(1)))
    assert all(r.score > 0.99 for r in quality.score(rows, one).collect())
    empty = quality.measured(docs.limit(0))
    assert quality.train(empty, labels) is None and quality.score(empty, one).count() == 0
    assert rows_of(quality.score(rows.withColumn("statistics", F.lit(None).cast("array<double>")).limit(1), one).select("score"))
