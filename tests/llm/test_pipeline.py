import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from guardlake.llm import common, shingles, stages, toxicity
from tests.llm.helpers import frame, rows_of
from tests.llm.test_dedup import groups, plain_lines

SMALL = "/root/testdata/sf0.001"


def test_pipeline_by_brute_force(spark, sf):
    docs = common.load(spark, sf, "documents")
    score = toxicity.train(docs, common.load(spark, sf, "labels")).scorer()
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    kept = [(i, t) for i, t in rows if score(t) < 0.5]
    kept = list(plain_lines(kept).items())
    sets = [shingles.shingles(t, 5) for _, t in kept]
    n = len(kept)
    near = [(a, b) for a in range(n) for b in range(a) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    root = groups(n, near)
    kept = [kept[i] for i in range(n) if root[i] == i]

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in kept:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    out = corpus_pipeline.run(spark, sf)
    assert rows_of(out.select("doc_id", "piece", "start", "length", "ids_crc32")) == sorted(want, key=repr)
    assert out.select("sequence_id", "offset").distinct().count() == len(want)


def test_stages_keep_the_columns(spark, sf):
    docs = frame(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert stages.packed(spark, docs.limit(0), sf).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "packing"]
