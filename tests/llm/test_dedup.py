import random

import numpy as np
import pytest
import xxhash

from guardlake.llm import common, embeddings, linededup, simhash
from tests.llm.helpers import frame, prose, texts


def plain_print(text, k):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_bk_tree_finds_what_a_scan_finds():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) for b in base for _ in range(20)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for radius in (0, 2, 6):
        for v in values[:60]:
            found = {tree.values[i] for i in tree.within(v, radius)}
            assert found == {x for x in values if (x ^ v).bit_count() <= radius}


def test_fingerprints_and_components(spark):
    rows = texts()
    out = simhash.near_duplicates(frame(spark)).collect()
    prints = [plain_print(t, 3) for _, t in rows]
    assert sorted((r.doc_id or -1, r.fp & (1 << 64) - 1) for r in out) == sorted((i or -1, p) for (i, _), p in zip(rows, prints))
    n = len(rows)
    root = groups(n, [(a, b) for a in range(n) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    want = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        want.append((rows[i][0] or -1, min(ids) if ids else None))
    assert sorted(((r.doc_id or -1, r.component_id) for r in out), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("radius,bands,tree_rows", [(2, 4, 4096), (2, 4, 7), (6, 8, 5)])
def test_links_connect_all_near_fingerprints(spark, radius, bands, tree_rows):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(8)]
    values = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) for b in base for _ in range(25)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {tuple(r) for r in simhash.links(df, radius, bands, tree_rows).collect()}
    number = {v: i for i, v in enumerate(signed)}
    near = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= radius]
    assert groups(len(values), [(number[a], number[b]) for a, b in got]) == groups(len(values), near)


def test_simhash_keeps_one_of_each_group(spark):
    docs = frame(spark)
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(13) == 1 and {6, 4, 11} <= set(ids) and 7 not in ids
    assert simhash.deduplicate(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500, 500 + i) for i in range(60)] + [(900 + i, 901 + i) for i in range(40)]
    out = {r.node: r.component for r in common.components(spark.createDataFrame(pairs + [(7, 7)], "a long, b long")).collect()}
    root = groups(1000, pairs)
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert all(out.get(x, x) == root[x] for x in linked)


def plain_lines(docs, least=50):
    """Line deduplication by definition, on (id, text) in order."""
    blank = " \t\x0b\f\r"
    kept = {k: [(i, x.strip(blank)) for i, x in enumerate((t or "").split("\n")) if x.strip(blank)] for k, t in docs}
    lines, places, gone = {k: [x for _, x in kept[k]] for k, _ in docs}, {}, {}
    for k, _ in docs:
        own = lines[k]
        sizes = [len(x.replace("\t", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split()) for x in own]
        for p, line in enumerate(own):
            # The longest run from here that any earlier place holds.
            for of, at in places.setdefault(line, []):
                n, other = 0, lines[of]
                while p + n < len(own) and at + n < len(other) and own[p + n] == other[at + n]:
                    n += 1
                if sum(sizes[p : p + n]) >= least:
                    gone.setdefault(k, set()).update(range(p, p + n))
            places[line].append((k, p))
    out = {}
    for k, t in docs:
        drop, number = set(), [i for i, _ in kept[k]]
        for i in gone.get(k, ()):
            drop.add(number[i])
            if i + 1 in gone[k]:
                drop.update(range(number[i], number[i + 1]))
        out[k] = t if not drop else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)
    return out


def test_line_dedup_by_definition(spark):
    rng = random.Random(11)
    lines = [prose(i, rng.randint(1, 20), 20) for i in range(12)]
    docs = [(i, "\n".join(rng.choice(lines + ["", " \t"]) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    docs += [(60, "\n".join(["w1 w2 w3"] * 60)), (61, None), (62, ""), (63, docs[0][1])]
    out = {r.doc_id: r.text for r in linededup.deduplicate(frame(spark, docs)).collect()}
    assert out == plain_lines(docs)
    assert out[60] == "w1 w2 w3"
    # Long lines between short ones: tails of runs differ from place to place.
    lines = [prose(100 + i, rng.choice([2, 5, 45, 60]), 60) for i in range(8)]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14)))) for i in range(80)]
    assert {r.doc_id: r.text for r in linededup.deduplicate(frame(spark, docs)).collect()} == plain_lines(docs)


def test_line_dedup_finds_the_longest_run_of_any_earlier_place(spark):
    a, t, u, v = prose(70, 60, 60), prose(71, 10, 10), prose(72, 10, 10), prose(73, 8, 8)
    docs = [(1, f"{a}\n{u}"), (2, f"{a}\n{t}"), (3, f"{a}\n{t}"), (4, f"{a}\n{t}\n{v}\n{u}"), (5, f"{u}\n{a}\n{t}\n{v}"), (6, f"{a}\n{t}\n{v}\n{u}\n{v}")]
    out = {r.doc_id: r.text for r in linededup.deduplicate(frame(spark, docs)).collect()}
    assert out == plain_lines(docs) and out[3] == "" and out[2] == t and out[6] == v


def test_line_dedup_awkward_rows(spark):
    docs = frame(spark)
    out = linededup.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by_id = {r.doc_id: r.text for r in out.collect() if r.doc_id not in (13, 14, None)}
    assert by_id[1] == prose(1) and by_id[2] == "" and by_id[7] is None and by_id[6] == "" and by_id[9] == "one"
    assert linededup.deduplicate(docs.limit(0)).count() == 0


def test_embeddings_by_brute_force(spark):
    rng = np.random.default_rng(1)
    base, rows = rng.normal(size=(30, 24)), []
    for b in range(30):
        for _ in range(rng.integers(1, 7)):
            rows.append((len(rows), (base[b] + rng.normal(size=24) * rng.choice([0, 0.03, 0.1, 0.15])).astype("f4").tolist(), b % 3))
    odd = [(None, 1), ([0.0] * 24, 1), ([float("nan")] + [1.0] * 23, 1), (base[0].astype("f4").tolist(), None), ([], 1)]
    odd += [([float("inf")] * 24, 0), ([None] + [1.0] * 23, 0), ([1.0, 2.0], 0), ([2.0, 4.0], 0), ([3.0], 0), ([1.0], 0)]
    rows += [(len(rows) + i, v, label) for i, (v, label) in enumerate(odd)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, key int, links int, a int")
    sound = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]

    def near(x, y):
        u, v = np.array(x[1], "f8"), np.array(y[1], "f8")
        return x[2] == y[2] and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98

    n = len(sound)
    pairs = [(a, b) for a in range(n) for b in range(a) if near(sound[a], sound[b])]
    root, degree = groups(n, pairs), np.bincount(np.array(pairs).ravel(), minlength=n)
    want = {r[0]: (0, r[0], True) for r in rows}
    for i, r in enumerate(sound):
        want[r[0]] = (degree[i], sound[root[i]][0], root[i] == i)
    for tile in (1024, 16):
        out = embeddings.near_duplicates(df, tile=tile, sample=40).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_windows_move_once_for_both_sides_of_a_match(spark):
    from guardlake.llm import linededup

    docs = spark.createDataFrame([(i, "\n".join(["word " * 30] * 3)) for i in range(4)], "doc_id long, text string")
    keys = ["spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("false", "-1")):
            spark.conf.set(k, v)
        runs = linededup.repeated_runs(docs)
        plan = runs._jdf.queryExecution().executedPlan().toString()
        assert [r.runs[0].start for r in runs.orderBy("doc").collect()] and plan.count("ReusedExchange [d#") == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
