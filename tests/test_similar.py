"""The similarity join against all pairs, and how much it moves."""

from __future__ import annotations

import random
import re
from pathlib import Path

import __spark_entry__ as entry
from textloom.functions.text import SPACE
from textloom.operators import similar


def plain(text):
    return set(re.split(f"{SPACE}+", text))


def test_token_sets():
    r = random.Random(2)
    texts = ["", " ", "a", " a", "a﻿", "﻿a b", "a\x1cb", "a\x85b c", "a b　", "\na  a\tb"]
    texts += ["".join(r.choices("ab \t\n\x0b\x1d\x85\xa0 ﻿", k=9)) for _ in range(500)]
    assert [similar.token_set(t) for t in texts] == [plain(t) for t in texts]


def test_classes_and_links_against_all_pairs(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.sample(words, r.randint(1, 12))) for _ in range(80)]
    texts += [t + " more" for t in texts[:40]] + [t + " " for t in texts[:20]] + texts[:10] + [" ".join(reversed(t.split())) for t in texts[:10]]
    texts += ["", " ", None, None, "x" * 50_001, "x" * 50_001, "\U0001f600" * 25_001, "e﻿m", "e m"]
    ids = r.sample(range(1000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    sets = {i: plain(t) if t is not None and len(t.encode("utf-16-le")) <= 100_000 else None for i, t in zip(ids, texts, strict=True)}
    rep = {i: min(j for j in ids if j == i or (s is not None and sets[j] == s)) for i, s in sets.items()}
    own = [i for i in ids if rep[i] == i and sets[i] is not None]
    for threshold in (0.3, 0.8, 1.0):
        members, links = similar.classes(df, threshold, 50_000)
        assert {x.id: x.rep_id for x in members.collect()} == rep and members.count() == len(ids)
        got = sorted((min(x.id_a, x.id_b), max(x.id_a, x.id_b), x.similarity) for x in links.collect())
        alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        assert got == sorted((i, j, alike(i, j)) for i in own for j in own if i < j and alike(i, j) >= threshold)


def test_pairs_move_less_than_a_few_times_the_input(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    size = sum(p.stat().st_size for p in Path(f"{tmp_path}/documents.parquet").glob("*.parquet"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert entry.queries()["jaccard_pairs"](spark, str(tmp_path)).count() > 1000
    print("shuffle written, times the input:", (written() - before) / size)
    assert written() - before < 4 * size
