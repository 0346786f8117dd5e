from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from textloom.llm import simhash
from textloom.llm.common import LOWER_BYTES


def brute_print(text):
    own = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER_BYTES))
    if not own:
        return 0
    h = [xxhash.xxh64(b" ".join(x), seed=42).intdigest() for x in ([own[i : i + 4] for i in range(len(own) - 3)] or [own])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, radius=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("part", [4096, 3])
def test_classes(odd, odd_rows, part):
    prints = [brute_print(t) for _, t in odd_rows]
    of = brute_classes(prints)
    ids = defaultdict(list)
    for (i, _), c in zip(odd_rows, of):
        ids[c].append(i)
    want = sorted((-1 if i is None else i, f"{p:016x}", min((x for x in ids[c] if x is not None), default=-1)) for (i, _), p, c in zip(odd_rows, prints, of))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in simhash.classes(odd, part=part).collect())
    assert got == want
    assert len({c for *_, c in got}) < len(got) - 15


@pytest.mark.parametrize("n", [1, 63, 65, 400])
@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_bit_sliced_distances(n, radius):
    r = np.random.default_rng(n)
    p = r.integers(0, 1 << 63, size=max(1, n // 8), dtype=np.uint64)[r.integers(0, max(1, n // 8), n)]
    for _ in range(5):
        p ^= np.where(r.random(n) < 0.7, np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
    first = np.arange(n) + 1
    got = {(a, b) for x, y in simhash.near(p, first, np.maximum(first, n), radius) for a, b in zip(x.tolist(), y.tolist())}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if (int(p[i]) ^ int(p[j])).bit_count() <= radius}


@pytest.mark.parametrize("rows", [10, 1 << 18, 1 << 24, 1 << 34])
def test_blocks_lose_no_pair(rows):
    masks = simhash.choice(rows, 4)
    r = np.random.default_rng(0)
    for _ in range(2000):
        d = sum(1 << int(b) for b in r.choice(64, 4, replace=False))
        assert any(not d & m for m in masks)


def test_empty(empty):
    assert simhash.classes(empty).count() == 0
