from __future__ import annotations

import numpy as np

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_fiftieth_vector_is_a_query(spark):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for r in entry.queries()["cosine_topk_each"](spark, SF).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.similarity)
    assert set(got) == set(ids[ids % 50 == 0].tolist()) and len(got) > 1
    for q, found in got.items():
        want = np.sort(m @ m[ids == q][0])[::-1][:10]
        assert np.allclose(found, want, atol=2e-6)
