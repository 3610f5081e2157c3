import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from guardlake.llm import common, licenses, packing, pieces, ppm, queries, toxicity, warc, winnowing
from tests.llm.helpers import frame, prose, rows_of, texts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# Winnowing


def plain_winnow(hashes, window):
    out = []
    for start in range(max(len(hashes) - window, 0) + bool(hashes)):
        part = hashes[start : start + window]
        low = min(part)
        chosen = (low, start + max(i for i, h in enumerate(part) if h == low))
        if not out or out[-1] != chosen:
            out.append(chosen)
    return out


def test_winnow_by_definition():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(0, 60)))
        k, window = rng.randint(1, 6), rng.randint(1, 9)
        hashes = winnowing.grams(text, k)
        runs = [text[i : i + min(k, len(text))] for i in range(len(hashes))]
        assert len(set(hashes.tolist())) == len(set(runs))
        assert list(zip(*(x.tolist() for x in winnowing.winnow(text, k, window)))) == plain_winnow(hashes.tolist(), window)


def test_shared_passage_leaves_a_shared_fingerprint():
    passage = prose(50, 10)[: winnowing.GRAM + winnowing.WINDOW - 1]
    a, b = prose(51) + passage + prose(52), prose(53) + passage + prose(54)
    assert set(winnowing.winnow(a)[0].tolist()) & set(winnowing.winnow(b)[0].tolist())


def test_edits_by_definition(spark):
    rows = [(i, t) for i, t in texts() if i is not None]
    rows = [r for n, r in enumerate(rows) if r[0] not in [x[0] for x in rows[:n]]]
    out = {r.doc_id: r for r in winnowing.compare_edits(frame(spark, rows)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        third = len(t) // 3
        changed = t[: len(t) - third] + after[:third]
        own, other, following = (winnowing.winnow(x)[0] for x in (t, changed, after))
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (winnowing.shown(own), winnowing.shown(other))
        assert (r.near_edited, r.near_next) == (winnowing.likeness(own, other), winnowing.likeness(own, following))
    assert out[1].fingerprint == out[2].fingerprint and len(out) == len(rows)


def test_edits_awkward_rows(spark):
    docs = frame(spark)
    out = winnowing.compare_edits(docs).collect()
    assert sorted(r.doc_id or -1 for r in out) == sorted(r.doc_id or -1 for r in docs.collect())
    assert winnowing.compare_edits(docs.limit(0)).count() == 0
    single = winnowing.compare_edits(frame(spark, [(1, "abcdef")])).first()
    assert single.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and single.near_next == 1.0
    found = winnowing.fingerprints(docs.where("doc_id in (1, 6, 7)")).collect()
    hashes, at = winnowing.winnow(prose(1))
    assert sorted((r.hash, r.position) for r in found) == sorted(zip(hashes.tolist(), at.tolist()))


# Toxicity


def test_toxicity_learns_held_out_labels(spark, sf):
    out = queries.op5_toxicity(spark, "/root/testdata/sf0.01")
    labels = common.load(spark, "/root/testdata/sf0.01", "labels")
    rows = out.join(labels, "doc_id").where("toxic is not null").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    positive, negative = ([r.score for r in held if r.toxic == y] for y in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in positive for n in negative])
    assert auc > 0.8 and np.mean([n >= 0.5 for n in negative]) < 0.05


def test_machine_learns_a_pair_that_no_weight_holds(spark):
    """Either of two words is toxic, both or none are not: no sum of weights tells that."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = prose(5000 + i, 8).split() + ["insult"] * a + ["people"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a != b)))
    docs = frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.score(docs, model).select("doc_id", "score").collect()
    held = [(r.score >= 0.5) == labels[r.doc_id][1] for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 200 and np.mean(held) > 0.95


def test_toxicity_scores_by_definition(spark, sf):
    docs = common.load(spark, sf, "documents").unionByName(frame(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    model = toxicity.train(docs, common.load(spark, sf, "labels"))

    def plain(text):
        names = {w for w in re.findall(r"\w+", (text or "").lower())}
        names |= {w[:n] + "*" for w in names for n in range(3, 10) if n < len(w)}
        at = sorted({zlib.crc32(x.encode()) % (1 << 20) for x in names})
        total = model.bias + sum(float(model.w[i]) for i in at)
        some = [i for i in at if model.v[i].any()]
        v = model.v[some].astype("f8")
        total += sum(float(v[i] @ v[i + 1 :].sum(axis=0)) for i in range(len(some)))
        return 1 / (1 + math.exp(-min(max(total, -40), 40)))

    rows = toxicity.score(docs, model).select("text", "score").collect()
    assert np.allclose([r.score for r in rows], [plain(r.text) for r in rows], atol=1e-9)


def test_toxicity_awkward_rows(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(1, 19)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model, column="n_chars")
    assert out.columns == docs.columns and out.count() == docs.count()
    scores = {r.doc_id: r.n_chars for r in out.collect()}
    assert scores[6] == scores[7] and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.train(docs, labels.limit(0)) is None and toxicity.score(docs, None).first().score == 0.0
    assert toxicity.score(docs.limit(0), model).count() == 0


# SentencePiece


def test_pieces_as_the_library(spark):
    encoder = pieces.Encoder(PIECES)
    assert encoder.by_word
    odd = ["  a  b ", " x\n\ny z\n", "<s> hi </s>", "▁ ▁a▁b c", " ", "a ", " a", "\n", " \n ", "\x00 q"]
    cases = [(i, t) for i, (_, t) in enumerate(texts())] + [(100 + i, t) for i, t in enumerate(odd)]
    found = {r.doc_id: r for r in pieces.encode(frame(spark, cases), PIECES).collect()}
    short = {r.doc_id: r for r in pieces.digests(frame(spark, cases), PIECES).collect()}
    for i, t in cases:
        raw, r = (t or "").encode(), found[i]
        want = encoder.model.encode(t or "", add_eos=True)
        assert r.ids == want and r.decoded == encoder.model.decode(want)
        assert b"".join(raw[a:b] for a, b in zip(r.begins, r.ends)) == raw and (not raw or r.begins[0] == 0)
        assert (short[i].n_tokens, short[i].ids_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert short[i].decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
        spans = np.array(list(zip(r.begins, r.ends)), "<i8").reshape(-1, 2)
        assert short[i].spans_crc32 == zlib.crc32(spans.tobytes())
    assert pieces.digests(frame(spark).limit(0), PIECES).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("options", [{}, {"add_dummy_prefix": False}, {"remove_extra_whitespaces": False}, {"escape_whitespaces": False}])
def test_normalisation_by_the_compiled_map(rule, options):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb2

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **options)
    spec = pb2.ModelProto()
    spec.ParseFromString(library.serialized_model_proto())
    encoder = pieces.Encoder.__new__(pieces.Encoder)
    encoder.rules, encoder.suffix, encoder.own = spec.normalizer_spec, False, None
    encoder.map = pieces.CharMap(spec.normalizer_spec.precompiled_charsmap)
    encoder.plain = not encoder.map.units and not encoder.rules.remove_extra_whitespaces and encoder.rules.escape_whitespaces
    for text in ["ﬁ Ａ  b", "  ①② x  ", "ｶﾞ ﾊﾟ", "", "   ", "Ａ　b\t c", "é É", "ﷺ z", "a\x07b", prose(3)]:
        want, offsets = library.normalize(text, with_offsets=True)
        got, origin = encoder.normalise(text)
        assert got.decode() == want
        places = np.cumsum([0] + [len(c.encode()) for c in want])
        assert [len(text.encode()[: origin[p]].decode()) for p in places] == list(offsets)


# Packing


def plain_best_fit(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        open_bins = [(space, i) for i, space in enumerate(bins) if space >= length]
        if open_bins:
            bins[min(open_bins)[1]] -= length
        else:
            bins.append(capacity - length)
    return sorted(bins)


def test_best_fit_decreasing_by_definition():
    rng = random.Random(6)
    for _ in range(150):
        capacity = rng.choice([7, 10, 64, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 120))]
        rules, fill = packing.best_fit_decreasing(Counter(lengths), capacity), defaultdict(list)
        for length, n in Counter(lengths).items():
            own = [r for r in rules if r.length == length]
            for rank in range(n):
                r = [x for x in own if x.first <= rank][-1]
                fill[r.bin + (rank - r.first) // r.each].append((r.offset + (rank - r.first) % r.each * length, length))
        for placed in fill.values():
            placed.sort()
            assert [o for o, _ in placed] == [sum(n for _, n in placed[:i]) for i in range(len(placed))]
        assert sorted(capacity - sum(n for _, n in p) for p in fill.values()) == plain_best_fit(lengths, capacity)


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    odd = ["<|endoftext|> it's  we'll ", "a\x1cb \x85c", "  x", "x \n y", "日本　a"]
    docs = frame(spark, [*texts(), *((200 + i, t) for i, t in enumerate(odd))])
    found = packing.tokenized(docs, BPE, 2, 64, with_ids=True)
    out = packing.pack(found.withColumn("offset", F.lit(-1)), 64).collect()
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
    for i, t in [(i, t) for i, t in texts() if i not in (13, 14, None)] + [(200 + i, t) for i, t in enumerate(odd)]:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in own) == ids.tobytes() and all(r.length == 64 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        placed.sort()
        assert [o for o, _ in placed] == [sum(n for _, n in placed[:i]) for i in range(len(placed))]
    assert sorted(64 - sum(n for _, n in p) for p in sequences.values()) == plain_best_fit([r.length for r in out], 64)
    assert packing.pack(packing.tokenized(docs.limit(0), BPE, 2, 64), 64).count() == 0


# Language model


def test_ppm_by_definition(spark):
    rows = [(i, t) for i, t in texts() if i is not None and i != 11]
    out = sorted(ppm.score(frame(spark, rows)).collect(), key=lambda r: (r.doc_id, r.score))
    token = [(i, ppm.tokens((t or "").encode().lower())) for i, t in rows]
    train = [w for i, w in token if zlib.crc32(str(i).encode()) % 5 != 1]
    assert 0 < len(train) < len(token)
    count = Counter(x for w in train for x in w)
    total, kinds = sum(count.values()), len(count)

    def symbols(words):
        return [ppm.START, *(b + ppm.BYTE for b in b" ".join(words[:-1])), ppm.END]

    trie = defaultdict(Counter)
    for words in train:
        s = symbols(words)
        for i in range(1, len(s)):
            for k in range(min(ppm.ORDER, i) + 1):
                trie[tuple(s[i - k : i])][s[i]] += 1

    def cost(words):
        s, sum_ = symbols(words), 0.0
        for i in range(1, len(s)):
            refused = set()
            for k in range(min(ppm.ORDER, i), -1, -1):
                left = {a: n for a, n in trie.get(tuple(s[i - k : i]), {}).items() if a not in refused}
                if not left:
                    continue
                twice = 2 * sum(left.values())
                if s[i] in left:
                    sum_ += math.log10((2 * left[s[i]] - 1) / twice)
                    break
                sum_ += math.log10(len(left) / twice)
                refused |= set(left)
            else:
                sum_ -= math.log10(ppm.ALPHABET - len(refused))
        return sum_

    want = sorted(
        (i, cost(w), sum(math.log10((count[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w), len(w), sum(count[x] > 0 for x in w))
        for i, w in token
    )
    for r, (i, score, base, n, known) in zip(out, want):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, n, known, total)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert abs(r.score - score) < 1e-7 and abs(r.base_score - base) < 1e-7
    assert len(out) == len(want)


def test_ppm_awkward_rows(spark):
    docs = frame(spark)
    out = ppm.score(docs).collect()
    assert len(out) == docs.count() and all(math.isfinite(r.score) for r in out)
    assert ppm.score(docs.limit(0)).count() == 0
    alone = ppm.score(frame(spark, [(i, "ab") for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1])).first()
    assert alone.train_tokens == 0 and abs(alone.score + 3 * math.log10(257)) < 1e-9


def test_ppm_beats_single_words_on_held_out_texts(spark):
    docs = common.load(spark, "/root/testdata/sf0.1", "documents").where("doc_id < 3000")
    best, base = ppm.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert best > base


# WARC


def plain_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def parsed(record: bytes):
    head, rest = bytes(record).split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    assert lines[0] == "WARC/1.1" and rest[int(fields["Content-Length"]) :] == b"\r\n\r\n"
    return fields, rest[: int(fields["Content-Length"])]


def test_derived_records_are_linked(spark):
    html = "<TITLE>Té</TITLE><script>a<b</script><p>x&amp;y<a class=c href=\"/1\">go</a>\r\n<br>z&#233;<!-- no -->"
    pages = spark.createDataFrame([(1, "http://a/", html, "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "", "x")], "page_id long, url string, html string, block string")
    source = warc.responses(pages)
    raw = {r.page_id: bytes(r.record) for r in source.collect()}
    out = warc.derive(source).collect()
    assert len(out) == 8
    fields, block = parsed(raw[1])
    assert fields["WARC-Block-Digest"] == plain_digest(block) and fields["WARC-Payload-Digest"] == plain_digest(html.encode())
    made = {r.record_type: r for r in out if r.page_id == 1}
    conversion, text = parsed(made["conversion"].derived)
    assert text.decode() == made["conversion"].block == "Té\nx&ygo\nzé" and conversion["WARC-Type"] == "conversion"
    metadata, about = parsed(made["metadata"].derived)
    for f, body in ((conversion, text), (metadata, about)):
        assert f["WARC-Refers-To"] == fields["WARC-Record-ID"] and f["WARC-Refers-To-Target-URI"] == "http://a/"
        assert f["WARC-Source-Payload-Digest"] == fields["WARC-Payload-Digest"] and f["WARC-Block-Digest"] == plain_digest(body)
    lines = about.decode().split("\r\n")
    assert f"source-block-digest: {fields['WARC-Block-Digest']}" in lines and "source-payload-digest-holds: true" in lines
    assert f"conversion-record-id: {conversion['WARC-Record-ID']}" in lines and "outlink: /1" in lines and "title: Té" in lines
    assert "http-header: Content-Type: text/html; charset=utf-8" in lines


def test_links_in_any_quotation(spark):
    html = """<a href='/one'>1</a><A class=x HREF = /two?a=1&amp;b=2>2</A><a href="/th&#114;ee&unknown;&amp;lt;">3</a><a
        href="/fo\nur ">4</a><a name=5>5</a><area href="/no"><a href=''>6</a><a data-x="1"href="/glued">7</a>"""
    pages = spark.createDataFrame([(1, html)], "id int, html string")
    found = pages.select(warc.outlinks(F.col("html")).alias("links"), warc.plain_text(F.lit("a&amp;lt;&lt;b&&nope;&#38;gt; \t c\td"))).first()
    assert found[0] == ["/one", "/two?a=1&b=2", "/three&unknown;&lt;", "/four", ""] and found[1] == "a&lt;<b&&nope;> c d"


def test_awkward_records(spark):
    def response(body: bytes, extra: str = "", kind: str = "response"):
        head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <id>\r\n{extra}Content-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    latin = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n<p>caf\xe9"
    rows = [None, b"", b"junk", response(latin), response(b"no http"), response(b"x", kind="request"), response(b"HTTP/1.1 200 OK\r\n\r\nbad \xff byte")]
    rows.append(response(latin, "WARC-Block-Digest: sha1:WRONG\r\n"))
    out = warc.derive(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, record binary")).collect()
    text = {r.id: r.block for r in out if r.record_type == "conversion"}
    assert text == {3: "café", 4: "", 6: "bad � byte", 7: "café"}
    assert "source-block-digest-holds: false" in [r.block for r in out if r.id == 7 and r.record_type == "metadata"][0]
    assert warc.derive(spark.createDataFrame([], "id long, record binary")).count() == 0


# Licences


def plain_pairs(text):
    words = re.sub("[^a-z0-9]+", " ", "".join(c.lower() if c < "\x80" else c for c in text)).strip(" ").split(" ")
    return set(zip(words, words[1:]))


def test_licenses_by_definition(spark):
    apache = licenses.TEMPLATES[2][1]
    rows = [(1, "x\nReleased under the MIT license!\ny"), (2, None), (3, ""), (4, "All"), (5, "foo\n\n" + apache.replace(". ", ".\n") + "\n\nbar")]
    rows += [(6, "Licensed under CC BY-NC 4.0.\r\nall rights reserved"), (7, prose(1)), (None, "All rights reserved."), (8, "é " * 3000)]
    got = rows_of(licenses.scan(frame(spark, rows)))
    want = []
    for i, t in rows:
        whole = re.sub("\r\n?", "\n", t or "")
        parts = re.split("\n[ \t]*\n[ \t\n]*", whole)
        units = [("line", n, x) for n, x in enumerate(whole.split("\n"))] + [("paragraph", n, x) for n, x in enumerate(parts) if "\n" in x]
        for level, n, x in units + ([("text", 0, whole)] if len(parts) > 1 else []):
            own = plain_pairs(x)
            near = [(-2 * len(own & plain_pairs(w)) / (len(own) + len(plain_pairs(w))), name) for name, w in licenses.TEMPLATES]
            if own and -min(near)[0] >= 0.8:
                want.append((i, level, n, min(near)[1], -min(near)[0]))
    assert got == sorted(want, key=repr) and {w[3] for w in want} >= {"MIT", "Apache-2.0", "CC-BY-NC-4.0", "proprietary"}
    assert licenses.scan(frame(spark).limit(0)).count() == 0


def test_references_and_digests_take_no_step_per_character(spark):
    page = "<p>a &lt;b&gt; &amp;lt; &amp;amp; &copy&copy; &nope; &#38;quot;<br> x \u00a0 <DIV>y</DIV><pre>z</pre>\n \n <b>w</b><prefix>v"
    df = spark.createDataFrame([(page,)], "t string").select(
        warc.plain_text(F.col("t")).alias("text"), warc.digest(F.encode("t", "UTF-8")).alias("digest")
    )
    got = df.first()
    assert got.text == "a <b> &lt; &amp; &copy\u00a9 &nope; \"\nx\ny\nz\nwv"
    assert got.digest == "sha1:" + base64.b32encode(hashlib.sha1(page.encode()).digest()).decode()
    plain = spark.createDataFrame([("x",)], "text string")
    digest, named = (
        plain.select(c.alias("made"))._jdf.queryExecution().optimizedPlan().toString() for c in (warc.digest(F.encode("text", "UTF-8")), warc._named(F.col("text")))
    )
    assert digest.count("conv(") == 4 and "element_at(" not in named
