from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from textloom.llm import shingles

SCHEMA = "doc_id long, text string"


def brute_sets(texts, k=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = [t.translate(lower).encode().split() for t in texts]
    return [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in own]


def brute_roots(texts, least=0.8):
    """The smallest place that links lead to, all pairs compared."""
    sets, root = brute_sets(texts), list(range(len(texts)))
    for y in range(len(sets)):
        for x in range(y):
            shared = len(sets[x] & sets[y])
            if sets[x] == sets[y] or shared >= least * (len(sets[x]) + len(sets[y]) - shared) > 0:
                a, b = sorted((root[x], root[y]))
                root = [a if r == b else r for r in root]
    return root


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeiontrsh") for _ in range(r.randint(2, 7))) for _ in range(500)]
    line = [r.choice(vocabulary) for _ in range(30)]
    texts = ["", " ", "one", "One", "one two"]
    for n in range(60):
        own = [r.choice(vocabulary) for _ in range(r.randint(10, 150))] + (line if n % 2 else [])
        texts.append(" ".join(own))
        for _ in range(n % 4):  # from nearly equal to well below 0.8
            other = list(own)
            for _ in range(r.randint(1, max(1, len(own) // 20))):
                other[r.randrange(len(other))] = r.choice(vocabulary)
            texts.append(" ".join(other[r.randint(0, 5) :]))
    return texts


@pytest.mark.parametrize("part", [800_000, 150])
def test_classes_against_all_pairs(spark, part):
    texts = corpus()
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)
    got = {r.doc_id: (r.component_id, r.kept) for r in shingles.classes(rows, part=part).collect()}
    assert got == {n: (c, n == c) for n, c in enumerate(brute_roots(texts))}


def test_order_of_shingles_changes_nothing():
    texts = corpus(4)
    sets = [shingles.shingles(t) for t in texts]
    want = brute_roots(texts)
    got = shingles.join(sets, np.zeros(len(sets), int), 0.8).tolist()
    assert got == [n if not len(sets[n]) else w for n, w in enumerate(want)]


def band(prints, number, bits):
    """A band's bits, as `band_key` takes them."""
    word, at = divmod(number, 64 // bits)
    return prints[word] >> at * bits & (1 << bits) - 1


@pytest.mark.parametrize("n", [20, 40, 200])
def test_bands_find_pairs_of_the_least_similarity(n):
    """Sets of similarity 0.8 share a band and are within the radii as often as the layout says; small ones needn't."""
    r, lost = np.random.default_rng(n), 0
    bits, many = shingles.layout(1 << 18)
    for _ in range(300):
        own = r.integers(-(1 << 62), 1 << 62, 2 * n)
        k = round(n * 0.2 / 1.8)  # of n each, k differ
        prints = [shingles.fingerprints(s, shingles.words_of(bits, many)) for s in (own[:n], own[k : n + k])]
        both = [np.array(p[:2], np.uint64) for p in prints]
        far = np.bitwise_count(both[0] ^ both[1])
        lost += far[0] > shingles.RADIUS or far.sum() > shingles.BOTH or all(band(prints[0], b, bits) != band(prints[1], b, bits) for b in range(many))
    assert lost <= (3 if n > shingles.SMALL else 100)


@pytest.mark.parametrize("rows", [10, 1 << 18, 1 << 30, 1 << 36])
def test_layout_misses_few(spark, rows):
    bits, many = shingles.layout(rows)
    assert (1 - shingles.AGREE**bits) ** many <= shingles.MISS and rows >> bits <= 512
    if many < 200:
        prints = [int(x) for x in np.random.default_rng(1).integers(0, 1 << 64, shingles.words_of(bits, many), dtype=np.uint64)]
        signed = np.array(prints, np.uint64).view(np.int64).tolist()
        row = spark.createDataFrame([(signed,)], "p array<long>")
        got = row.select(*[shingles.band_key(F.col("p"), b, bits).alias(f"b{b}") for b in range(many)]).first()
        assert list(got) == [b << 48 | band(prints, b, bits) for b in range(many)]


def test_odd_rows(odd, odd_rows, empty):
    """Null and empty texts are alike, rows that repeat are each returned, clashing columns don't matter."""
    got = shingles.classes(odd).collect()
    root = brute_roots([t or "" for _, t in odd_rows])
    ids = {}
    for (i, _), c in zip(odd_rows, root):
        ids.setdefault(c, []).append(i)
    want = sorted((-1 if i is None else i, min((x for x in ids[c] if x is not None), default=-1)) for (i, _), c in zip(odd_rows, root))
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.component_id is None else r.component_id) for r in got) == want
    assert shingles.classes(empty).count() == 0


def test_stage_takes_near_copies_far_in_fingerprint(spark):
    """Similarity 0.8 of five-word shingles counts, whatever the fingerprints; below it nothing does."""
    words = [f"w{n}" for n in range(104)]  # 100 shingles
    above, below = list(words), list(words)
    for at in (20, 60):  # 10 shingles each: 90 of 110
        above[at] = "x"
    for at in (20, 50, 80):  # 85 of 115
        below[at] = "y"
    rows = [(1, " ".join(words), "en"), (2, " ".join(above), "en"), (3, " ".join(below), "en")]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang string")
    assert sorted(r.doc_id for r in pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]
