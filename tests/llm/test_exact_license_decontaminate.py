from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from textloom.llm import decontaminate, exact, license

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


@pytest.mark.parametrize("memtable", [4_000_000, 8])
def test_exact(odd, odd_rows, memtable):
    """With one level and with several."""
    docs = odd if memtable > 8 else odd.repartition(40)
    got = exact.groups(docs, memtable=memtable, fanin=4 if memtable > 8 else 2).collect()
    by = defaultdict(list)
    for i, t in odd_rows:
        by[t or ""].append(i)
    least = lambda x: -(1 << 63) if x is None else x
    want = []
    for t, ids in by.items():
        keep = max(ids, key=least)
        want += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest(), min(ids, key=least)) for i in ids]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256, r.least_id) for r in got), key=key) == sorted(want, key=key)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(by) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_hot_group(spark):
    """One text has a third of the rows, another is null: every row finds its group."""
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('t', id % 1000) END AS text").repartition(7)
    want = defaultdict(list)
    for r in rows.collect():
        want[r.text or ""].append(r.doc_id)
    got = {r.doc_id: (r.keep_id, r.group_size, r.least_id) for r in exact.groups(rows).collect()}
    assert got == {i: (max(x), len(x), min(x)) for x in want.values() for i in x}


def test_exact_takes_equal_digests_apart(spark, odd, odd_rows, monkeypatch):
    """With a digest of one bit, groups must still be those of the texts."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "sha2", lambda c, n: F.lpad(F.conv(F.length(c) % 2, 10, 16), 64, "0"))
    by = defaultdict(list)
    for i, t in odd_rows:
        by[t or ""].append(i)
    got = exact.groups(odd).collect()
    assert sorted(r.group_size for r in got) == sorted(len(x) for x in by.values() for _ in x)
    assert sum(r.kept for r in got) == len(by)


@pytest.mark.parametrize("f", [exact.groups, license.scan])
def test_empty(empty, f):
    assert f(empty).count() == 0


def brute_licenses(own):
    """Labels and shares by trying every beginning of every notice; no words are looked up first."""
    found = []
    get = lambda x: own[x] if 0 <= x < len(own) else None
    for label, notice, phrase in license.TEMPLATES:
        n, p = notice.split(), phrase.split()
        k = next(k for k in range(len(n)) if n[k : k + len(p)] == p)
        for s in range(-len(n), len(own)):
            share = sum(get(s + j) == w for j, w in enumerate(n)) / len(n)
            if share >= license.COVERAGE and all(get(s + k + j) == w for j, w in enumerate(p)):
                found.append((label, share))
    return found


def assert_licenses(docs, rows):
    got = {(r.doc_id, r.n_words, r.n_base): r for r in license.scan(docs).collect()}
    many = 0
    for i, t in rows:
        own = words(t)
        at = [(k, x) for p, x in license.BASE.items() for k in range(len(own)) if own[k : k + len(p.split())] == p.split()]
        r = got[i, len(own), len(at)]
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        more = brute_licenses(own)
        many += len(more)
        assert r.labels == ",".join(sorted({x for _, x in at} | {x for x, _ in more})), t
        assert r.score == (1.0 if at else max((x for _, x in more), default=0.0))
    return many


def test_license(odd, odd_rows):
    assert assert_licenses(odd, odd_rows) > 3


def test_license_finds_altered_notices(spark):
    """Whichever words are altered, left out, or common in the corpus: as all beginnings say."""
    r = random.Random(2)
    rows, common = [], ["the", "of", "license", "software", "copy", "this", "under", "to", "and", "is", "x"]
    for _, notice, _ in license.TEMPLATES:
        own = notice.split()
        for share in (0.0, 0.1, 0.2, 0.25):
            for _ in range(6):
                new = [r.choice(common) if r.random() < share else w for w in own]
                if r.random() < 0.2:
                    del new[r.randrange(len(new))]
                around = [[r.choice(common) for _ in range(r.randint(0, 30))] for _ in range(2)]
                rows.append((len(rows), " ".join(around[0] + new + around[1])))
    rows.append((len(rows), "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following condition is met"))
    rows.append((len(rows), "mit license " * 20_000 + "released under the mit license"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    *short, last = rows
    assert assert_licenses(docs.where(f"doc_id < {last[0]}"), short) > 200
    assert license.scan(docs.where(f"doc_id = {last[0]}")).first().labels == "mit"


def brute_windows(docs, items, window=10):
    keys = defaultdict(set)
    for i, t in items:
        own = words(t)
        for k in range(max(1, len(own) - window + 1) if own else 0):
            keys[tuple(own[k : k + window])].add(i)
    out = []
    for d, t in docs:
        own, hit, found = words(t), set(), set()
        for k in range(len(own)):
            for n in {len(x) for x in keys}:
                if (of := keys.get(tuple(own[k : k + n]))) and k + n <= len(own):
                    hit.update(range(k, k + n))
                    found |= of
        out.append((d, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [2_000_000, 30])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_decontaminate(spark, odd, odd_rows, block, kind):
    """Against brute force, with null, repeated and string item ids, items that share windows, and several blocks."""
    long = [t for _, t in odd_rows if t and 15 < len(t.split()) < 200]
    items = [(1, long[0]), (10, long[1][:80]), (2, "a"), (2, "x y"), (3, ""), (4, None), (5, "!?"), (6, long[0]), (7, "x y z"), (None, "rights RESERVED"), (None, long[0])]
    items = [(i if i is None or kind == "long" else f"q{i}", t) for i, t in items]
    bench = spark.createDataFrame(items, f"item_id {kind}, text string")
    rows = decontaminate.scan(odd, bench, block_words=block).collect()
    want = brute_windows(odd_rows, items)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=key) == sorted(want, key=key)
    for r in rows:
        assert r.n_hit == sum(len(words(r.text[a:b])) for a, b in zip(r.starts, r.ends))
        assert r.items_sha256 == hashlib.sha256(",".join(r.items).encode()).hexdigest()
    few = decontaminate.scan(odd, bench, block_words=block, places=False)
    assert sorted(map(tuple, few.collect()), key=key) == sorted(want, key=key)


def test_spans_are_linear_in_long_texts():
    text = "é one two " * 300_000
    at = decontaminate.spans(text, [(3 * i + 1, 3 * i + 2) for i in range(300_000)])
    assert at[0] == (2, 5) and at[-1] == (len(text) - 8, len(text) - 5) and len(at) == 300_000


def test_decontaminate_empty(spark, empty, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(empty, none).count() == 0
    assert not decontaminate.scan(odd, none).where("contaminated").count()
