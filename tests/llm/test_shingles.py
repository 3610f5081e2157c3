import random

import numpy as np
from pyspark.sql import functions as F

from guardlake.llm import common, shingles, simhash
from tests.llm.helpers import frame, prose
from tests.llm.test_dedup import groups, plain_print


def edited(text, rng, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_are_those_of_the_shingle_similarity(spark):
    rng = random.Random(17)
    rows = [prose(1000 + i, rng.choice([3, 30, 60, 150])) for i in range(12)]
    rows += [edited(rows[rng.randrange(12)], rng, rng.randint(0, 3)) for _ in range(150)]
    rows += [edited(prose(2000 + i, 60) + " " + rows[0], rng, 1) for i in range(5)]
    rows += [None, "", "Same  words", "same words"]
    sets = [shingles.shingles(t, 5) for t in rows]
    n = len(rows)
    near = [(a, b) for a in range(n) for b in range(a) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    prints = [plain_print(t, 5) for t in rows]
    far = [(prints[a] ^ prints[b]).bit_count() for a, b in near]
    close = [(a, b) for a in range(n) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 6]
    assert max(far) > 14 and groups(n, close) != groups(n, near)
    root = groups(n, near)
    out = simhash.deduplicate(frame(spark, list(enumerate(rows))))
    assert sorted(r.doc_id for r in out.collect()) == [i for i in range(n) if root[i] == i]


def test_fingerprints_give_candidates_that_are_confirmed(spark, monkeypatch):
    rng = random.Random(23)
    rows = [prose(3000 + i, 300) for i in range(20)]
    rows += [edited(rows[i], rng, 1) for i in range(20)]
    asked = []
    confirmed = shingles._confirmed
    monkeypatch.setattr(shingles, "_confirmed", lambda pairs, *rest: (asked.append({tuple(r) for r in pairs.collect()}), confirmed(pairs, *rest))[1])
    seen = []
    found = simhash.candidates
    monkeypatch.setattr(simhash, "candidates", lambda sets: (seen.append({r.id: r.fp for r in sets.collect()}), found(sets))[1])
    assert sorted(r.doc_id for r in simhash.deduplicate(frame(spark, list(enumerate(rows)))).collect()) == list(range(20))
    prints = seen[0]
    near = {(min(a, b), max(a, b)) for a in prints for b in prints if a != b and (prints[a] ^ prints[b] & simhash.ALL).bit_count() <= 6}
    assert near and near <= asked[0]
    want = {plain_print(" ".join([t]), 5) for t in rows}
    assert len({p & simhash.ALL for p in prints.values()} & want) > 0


def test_candidates_are_near_fingerprints_of_every_group(spark):
    rng = random.Random(29)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = list({b ^ sum(1 << bit for bit in rng.sample(range(64), j)) for b in base for j in range(4)})
    values.append(values[0])
    df = spark.createDataFrame([(i, simhash._signed(v)) for i, v in enumerate(values)], "id long, fp long")
    n = len(values)
    near = {(a, b) for b in range(n) for a in range(b) if (values[a] ^ values[b]).bit_count() <= 6}
    root = groups(n, near)
    for rows in (4096, 3):
        pairs = {(min(r), max(r)) for r in map(tuple, simhash.candidates(df, tree_rows=rows).collect())}
        assert pairs <= near and (0, n - 1) in pairs
        assert {root[a] for a, _ in pairs} == {root[a] for a, _ in near}


def test_sketches_never_tell_sets_further_apart_than_they_are(spark):
    rng = random.Random(31)
    rows = []
    for size in [0, 1, 2, 5, 63, 64, 65, 300, 1000]:
        own = [rng.getrandbits(64) for _ in range(size)]
        for other in (own, own[: int(size * 0.9)], own[size // 3 :] + [rng.getrandbits(64) for _ in range(size // 4)]):
            one, two = (np.unique(np.array(x, dtype="<u8")) for x in (own, other))
            rows.append((len(set(own) ^ set(other)), shingles.odd_bits(one).tolist(), shingles.odd_bits(two).tolist()))
    df = spark.createDataFrame(rows, "d int, one array<long>, other array<long>")
    found = df.select("d", shingles.least_apart(F.col("one"), F.col("other")).alias("x")).collect()
    assert all(r.x <= r.d for r in found) and sum(r.x for r in found) > sum(r.d for r in found) / 3


def test_texts_move_only_where_sketches_allow_a_pair(spark, monkeypatch):
    rows = []
    for i in range(40):
        shared = prose(5000 + i, 14).split()
        rows += [" ".join(shared + prose(6000 + 2 * i + j, 40).split()) for j in range(2)]
    # Two that are alike, and all others with one passage in common by pairs.
    rows.append(" ".join(rows[0].split()[:-1]))
    tables, written = {}, common.written

    def counted(df, purpose, *rest, **options):
        out = written(df, purpose, *rest, **options)
        tables.setdefault(purpose, []).append(out.count())
        return out

    monkeypatch.setattr(common, "written", counted)
    out = simhash.deduplicate(frame(spark, list(enumerate(rows))))
    assert sorted(r.doc_id for r in out.collect()) == list(range(80))
    assert sum(tables["texts"]) == 2 < sum(tables["pairs"])
