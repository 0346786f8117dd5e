from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm.test_exact_license_decontaminate import brute_windows
from tests.llm.test_shingles import brute_roots
from textloom.llm import quality

SF = "/root/testdata/sf0.001"


def test_pipeline_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ok = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in ok]
    rows = list({t: (i, t) for i, t in sorted(rows)}.values())
    rows.sort()
    of = brute_roots([t for _, t in rows])
    rows = [r for n, r in enumerate(rows) if of[n] == n]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {w[0] for w in brute_windows(rows, items) if w[5]}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        if i not in hit:
            ids = np.array(library.encode(t, add_special_tokens=False).ids, "<u4")
            want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, SF).collect()]
    assert sorted(got) == want and 0 < len(want) < docs.count()


@pytest.mark.parametrize("n", range(5))
def test_stages_keep_columns_and_odd_rows(spark, odd, empty, n):
    _, stage = pipeline.STAGES[n]
    docs = odd.withColumnsRenamed({"n": "score", "digest": "hits", "row": "own_key"})
    got = stage(spark, docs, SF)
    if n == 4:
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == sorted(-1 if r.doc_id is None else r.doc_id for r in docs.collect())
        assert stage(spark, empty, SF).count() == 0
        return
    assert got.schema == docs.schema
    texts = [r.text for r in got.collect()]
    assert len(texts) > 10 or n == 0
    if n == 1:
        assert len({t or "" for t in texts}) == len(texts) == len({r.text or "" for r in odd.collect()})
    none = stage(spark, empty, SF)
    assert none.columns == empty.columns and none.count() == 0
