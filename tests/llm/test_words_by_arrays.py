from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from textloom.llm import quality


def plain(texts, number):
    """Units, shapes and repeats token by token."""
    words, shapes, repeats, ends = [], [], [], []
    for text in texts:
        own, last = text.split(), {}
        for i, t in enumerate(own):
            w, j = quality.word(t), last.get(t, -1)
            words.append(number.get(w, quality.VOCABULARY + w % quality.BUCKETS))
            shapes.append(zlib.crc32(quality.shape(t).encode()) % quality.SHAPES)
            step = int(np.frexp(float(i - j if j >= 0 else 0))[1])
            repeats.append(quality.SHAPES + min(step, 15) * 4 + 2 * (j > 0 and own[j - 1] == own[i - 1]) + (len(t) > 3))
            last[t] = i
        ends.append(len(words))
    return words, shapes, repeats, ends


@pytest.mark.parametrize("piece", [8, 64, None])
def test_reading_by_arrays_equals_reading_token_by_token(monkeypatch, piece):
    if piece:  # so that texts are read in pieces, and some tokens are longer than these
        monkeypatch.setattr(quality, "PIECE", piece)
    r = random.Random(3)
    some = ["a", "A", "Ab!", "(ab)", "ab", "12:30", "====", "...", "É", "é", "ß²", "😀😀", "𐐀x", "日本", "x" * 9, "X" * 200 + ".", "a-b-c-1", "\x1fz", "aaB0"]
    texts = ["", " ", "\n a b\x85c ", *[r.choice(["", " "]) + r.choice([" ", "\n\t"]).join(r.choice(some) for _ in range(r.randint(1, 90))) for _ in range(40)]]
    number = {quality.word(t): i for i, t in enumerate(["a", "ab", "é", "日本", "..."])}
    got = quality.Reader(number)(texts)
    for a, b in zip(got, plain(texts, number), strict=True):
        assert a.tolist() == b
    assert np.array_equal(np.concatenate([quality.Read([t]).words for t in texts]), quality.Read(texts).words)


def test_words_are_small_letters_without_marks():
    same = [("One", "one"), ("(ÉCLAIR!)", "éclair"), ('"a.b"', "a.b"), ("...", "?")]
    assert all(quality.word(a) == quality.word(b) for a, b in same)
    assert len({quality.word(t) for t in ("ab", "ba", "aab", "abb", "a.b", "b", "a", "!", "ａ", "aa", "aaa")}) == 11
    long = "y" * (quality.PIECE + 1)
    assert quality.word("a" + "." * len(long)) == quality.word("a") and quality.word(long + ",") == quality.word(long.upper()) != quality.word(long[1:])


def test_rare_tokens_cost_no_call_each(monkeypatch):
    """Almost every distinct token of a corpus is rare; a shape is spelled out once, not once for each token."""
    calls, own = [], quality.shape
    monkeypatch.setattr(quality, "shape", lambda t: calls.append(t) or own(t))
    rng = np.random.default_rng(0)
    vectors = quality.Vectors({12345: 0}, rng.random((quality.WORDS, quality.WIDTH)).astype(np.float32), rng.random((quality.FORMS, quality.WIDTH)).astype(np.float32))
    quality.features([" ".join(f"w{i * 1000 + j:07d}x" for j in range(1000)) for i in range(3)], vectors)
    assert len(calls) < 10
