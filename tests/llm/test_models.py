from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import hmm, langid, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def brute_base(rows):
    train = Counter(w for i, t in rows if hmm.fold(i, 5) != 1 for w in [*hmm.words(t or ""), hmm.END])
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        own = [*hmm.words(t or ""), hmm.END]
        out.append((i, hmm.fold(i, 5) == 1, len(own), sum(train[w] > 0 for w in own), n, sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)))
    return out


@pytest.mark.parametrize("head", [5, 200_000])
def test_hmm_counts_and_base(odd, odd_rows, head):
    got = hmm.score(odd, head=head, symbols=20, states=3, rounds=1).collect()
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    a = sorted((key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got))
    assert a == sorted(key((*w[:5], round(w[5], 6))) for w in brute_base(odd_rows))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_hmm_beats_the_base_on_held_out_texts(docs):
    got = [r for r in hmm.score(docs).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.2 * sum(r.n_tokens for r in got)


def model(k=3, size=4):
    rng = np.random.default_rng(0)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((size, k)), 0))


def paths(m, seq):
    for s in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[s[0]] * m.emit[seq[0], s[0]]
        for a, b, x in zip(s, s[1:], seq[1:]):
            p *= m.step[a, b] * m.emit[x, b]
        yield s, p


def test_forward_recursion_and_counts_equal_sums_over_all_paths():
    m = model()
    seqs = [np.array(s) for s in ([0], [1, 2], [3, 3, 0, 1, 2], [2, 1, 0])]
    assert np.allclose(hmm.likelihood(m, seqs), [math.log10(sum(p for _, p in paths(m, s))) for s in seqs])
    starts, steps, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for seq in seqs:
        total = sum(p for _, p in paths(m, seq))
        for s, p in paths(m, seq):
            starts[s[0]] += p / total
            for a, b in zip(s, s[1:]):
                steps[a, b] += p / total
            for x, a in zip(seq, s):
                emits[x, a] += p / total
    log = sum(math.log10(sum(p for _, p in paths(m, s))) for s in seqs)
    for block in (1, 2, 3, 1024):  # pieces of any length carry both recursions on
        assert np.allclose(hmm.likelihood(m, seqs, block), hmm.likelihood(m, seqs))
        *counts, total = hmm.expected(m, seqs, block)
        assert total == pytest.approx(log, rel=1e-5)
        for a, b in zip(counts, (starts, steps, emits)):
            assert np.allclose(a, b, rtol=1e-4)


def test_a_million_tokens_beside_short_texts_stay_small():
    """Counts are those of the uncut recursion, and memory doesn't grow as the longest times the number of texts."""
    import tracemalloc

    m, r = model(), np.random.default_rng(1)
    seqs = [r.integers(0, 4, 1_000_000), *[r.integers(0, 4, 5) for _ in range(511)]]
    tracemalloc.start()
    found = hmm.likelihood(m, seqs)
    starts, steps, emits, log = hmm.expected(m, seqs)
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
    a, total = m.start * m.emit[seqs[0][0]], 0.0
    for x in seqs[0][1:]:
        s = a.sum()
        total += math.log10(s)
        a = (a / s) @ m.step * m.emit[x]
    assert found[0] == pytest.approx(total + math.log10(a.sum()), rel=1e-9)
    assert log == pytest.approx(found.sum(), rel=1e-6)
    assert starts.sum() == pytest.approx(512) and steps.sum() == pytest.approx(sum(len(s) - 1 for s in seqs), rel=1e-4)
    assert np.allclose(emits.sum(axis=1), np.bincount(np.concatenate(seqs), minlength=4), rtol=1e-4)


def test_probabilities_of_all_tokens_sum_to_one(odd):
    from textloom.llm.common import id_text

    counts = hmm.token_counts(id_text(odd)).cache()
    known = hmm.vocabulary(counts, symbols=7, head=30)
    classes = Counter()
    for r in counts.where("c > 0").collect():
        at = known.number.get(bytes(r.token))
        if at is None or at >= known.singles:
            classes[r["class"]] += r.c + 0.5
    for c, total in enumerate(known.class_total):
        assert classes[c] + 0.5 == pytest.approx(total)
    assert known.share.sum() == pytest.approx(1)


def test_quality_on_held_out_labels(docs, labels):
    of = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.score(docs, labels).collect()
    own = [(r.predicted, of[r.doc_id]) for r in got if r.held_out and r.doc_id in of]
    assert len(got) == docs.count() and sum(a == b for a, b in own) / len(own) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (quality.FOLDS and hmm.fold(r.doc_id, 5) == 0) for r in got)


def plain_word(token):
    return token.lower().strip(".,;:!?()\"'")


def test_word_vectors_are_sums_of_neighbours(spark):
    """Vocabulary, sums and pooled features against plain loops over all tokens."""
    texts = ["", "One two, two ONE three!", "a", "==== 12:30 Ab\n\nAb ab (ab)", "x" * 10_000 + " one", "two one " * 50, "é É ²"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = {r.word: r.n for r in quality.word_counts(docs).collect()}
    want = Counter(plain_word(t) for x in texts for t in x.split())
    assert sorted(counts.values()) == sorted(want.values()) and all(counts[quality.word(t)] == n for t, n in want.items())
    number = quality.vocabulary(quality.word_counts(docs), most=4)
    assert set(number) <= {quality.word(t) for t, n in want.most_common(4)} and len(number) >= 2
    got = quality.word_vectors(docs, number)
    unit = lambda t: number.get(quality.word(t), quality.VOCABULARY + quality.word(t) % quality.BUCKETS)
    form = lambda t: zlib.crc32(quality.shape(t).encode()) % quality.SHAPES
    of_words, of_forms = quality.index_vectors(11, quality.WORDS).astype(float), quality.index_vectors(12, quality.FORMS).astype(float)
    sums = np.zeros((quality.WORDS, quality.WIDTH))
    for x in texts:
        own = x.split()
        for i, t in enumerate(own):
            sums[unit(t)] += of_forms[form(t)]
            for j in (i - 1, i + 1):
                if 0 <= j < len(own):
                    sums[unit(t)] += of_words[unit(own[j])]
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    plain = sums / np.where(norm > 0, norm, 1)
    plain = np.where(norm > 0, plain - plain.sum(axis=0) / (norm > 0).sum(), 0) + of_words / np.sqrt(quality.FILLED)
    assert np.allclose(got.words, plain, atol=1e-5)
    pooled = quality.features(texts, got)
    for x, row in zip(texts, pooled):
        mean = np.mean([plain[unit(t)] for t in x.split()], axis=0) if x.split() else np.zeros(quality.WIDTH)
        assert np.allclose(row[: quality.WIDTH], mean, atol=1e-5)


def test_shapes_are_of_whole_tokens():
    assert quality.shape("x" * 100 + "1") != quality.shape("x" * 100 + "-")
    assert quality.shape("a-b-c-d-e-f-g-h-1") != quality.shape("a-b-c-d-e-f-g-h-x")


def test_quality_learns_from_a_bounded_number_of_rows(spark, docs, labels):
    """An id that repeats counts once in learning; long texts and ties are scored like any other."""
    few, one = docs.select("doc_id", "text").where("doc_id < 200"), docs.where("doc_id = 1").first()
    copies = spark.range(300).select(F.lit(1).cast("long").alias("doc_id"), F.lit(one.text).alias("text"))
    long = spark.createDataFrame([(9_000_001, "word and " * 500_000), (9_000_002, "y" * 5_000_000)], few.schema)
    both = few.where("doc_id <> 1").unionByName(copies).unionByName(long)
    got = quality.score(both, labels).collect()
    assert len(got) == both.count() and len({r.score for r in got if r.doc_id == 1}) == 1
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_sees_no_held_out_label(spark, docs, labels):
    from textloom.llm.common import fold_col

    turned = labels.withColumn("quality", F.when(fold_col(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    few = docs.where("doc_id < 150")
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in quality.score(few, x).collect()) for x in (labels, turned))
    assert a == b


def test_quality_of_odd_rows(spark, odd, odd_rows, empty):
    marks = spark.createDataFrame([(20, 0, None), (20, 1, None), (21, None, None), (None, 1, None), (22, 7, None)], "doc_id long, quality int, text string")
    got = quality.score(odd, marks).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty, marks).count() == 0
    assert quality.score(odd, marks.limit(0)).count() == len(odd_rows)


def test_language(docs, odd, odd_rows, empty):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.predict(docs).collect()
    own = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert sum(own) / len(own) > 0.98
    assert all(0 <= r.score <= 1 and r.held_out == (hmm.fold(r.doc_id, 4) == 2) for r in got)
    assert {r.lang_pred for r in langid.predict(odd).collect()} == {"und"}  # all languages are null
    assert langid.predict(empty).count() == 0


def test_language_is_undetermined_without_letters(spark, docs):
    rows = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "12 ² !", "en"), (4, "é", "fr"), (5, "the and of", "en")], docs.select("doc_id", "text", "lang").schema)
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs.select("doc_id", "text", "lang").unionByName(rows.withColumn("doc_id", rows.doc_id + 10**7))).collect() if r.doc_id > 10**7}
    assert [got[10**7 + i] for i in (1, 2, 3)] == ["und"] * 3 and {got[10**7 + 4], got[10**7 + 5]} <= {"en", "fr", "de", "es"}


def gram_set(text):
    own = b" " + bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode()) + b" "
    return {own[i : i + n] for n in (1, 2, 3) for i in range(len(own) - n + 1)}


def plain_kernel(a, b):
    x, y = gram_set(a), gram_set(b)
    return len(x & y) / math.sqrt(len(x) * len(y))


def test_kernel_and_outputs_are_those_of_sets(docs):
    """Kernels, the Nyström map and the ridge regression against plain sets and the whole kernel matrix."""
    rows = [(r.text, r.lang) for r in docs.where("doc_id < 60 and lang is not null and length(text) < 4000").orderBy("doc_id").collect()]
    rows += [("a", "en"), ("zz " * 30, "de"), rows[0]]
    net = langid.fit(rows)
    chosen = [t for lang in net.languages for t in [t for t, x in rows if x == lang][: langid.LANDMARKS]]
    other = ["été à la plage", "the cat", "x", *[t for t, _ in rows[:10]]]
    want = np.array([[plain_kernel(a, b) for b in chosen] for a in other])
    assert np.allclose(net.landmarks.kernel(other), want, atol=1e-6)
    # all texts are landmarks here, so this is kernel ridge regression on all of them: f(x) = k(x) a with the same weights
    k = np.array([[plain_kernel(a, b) for b in chosen] for a, _ in rows])
    y = np.array([[1.0 if x == lang else -1.0 for lang in net.languages] for _, x in rows])
    w = np.array([len(rows) / sum(v == x for _, v in rows) for _, x in rows])
    kc = np.array([[plain_kernel(a, b) for b in chosen] for a in chosen])
    loss = lambda a: float((w[:, None] * (k @ a - y) ** 2).sum() + langid.RIDGE * np.trace(a.T @ kc @ a))
    best = loss(net.weights.astype(float))
    rng = np.random.default_rng(0)
    for scale in (1e-3, 1e-2, 0.1):
        assert all(loss(net.weights + rng.normal(0, scale, net.weights.shape)) > best * (1 - 1e-4) for _ in range(5))


def test_language_of_repeats_ties_and_long_texts(spark, docs):
    """A model is learned from rows of which a third is one text under null ids; bounds hold; equal texts are scored alike."""
    few = docs.select("doc_id", "text", "lang").where("doc_id < 300")
    one = few.where("doc_id = 1").first()
    copies = spark.range(150).select(F.lit(None).cast("long").alias("doc_id"), F.lit(one.text).alias("text"), F.lit(one.lang).alias("lang"))
    long = spark.createDataFrame([(9_000_001, "the quick brown fox and the lazy dog " * 140_000, None), (9_000_002, "a" * 5_000_000, None)], few.schema)
    both = few.unionByName(copies).unionByName(long)
    got = langid.predict(both, train=40).collect()
    assert len(got) == both.count() and all(0 <= r.score <= 1 for r in got)
    copied = {(r.lang_pred, r.score) for r in got if r.doc_id is None}
    assert len(copied) == 1 and len({r.held_out for r in got if r.doc_id is None}) == 1
    of = {r.doc_id: r.lang for r in few.collect()}
    own = [r.lang_pred == of[r.doc_id] for r in got if r.doc_id in of and r.held_out]
    assert sum(own) / len(own) > 0.9
