from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import bpe, tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_codec_equals_the_library(library, odd, odd_rows):
    got = {}
    for r in bpe.digests(odd, PATH).collect():
        got.setdefault(r.doc_id, set()).add((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    for i, t in odd_rows:
        ids = ids_of(library, t)
        text = library.decode(ids, skip_special_tokens=False)
        assert (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) in got[i]
    assert {r.text for r in bpe.encode(odd, PATH).collect()} == {t or "" for _, t in odd_rows}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", "ing", "a", " ", "  ", "\n", "\t", "'s", "1", "²", "é", "日", "😀", "<|endoftext|>", "<|end", "\x1c", "\x85", " ", "-", "S"]), max_size=30).map("".join))
def test_encoder_property(text):
    library = Tokenizer.from_file(PATH) if not hasattr(test_encoder_property, "t") else test_encoder_property.t
    test_encoder_property.t = library
    model, chunks = bpe.model(PATH)
    ids = ids_of(library, text)
    assert [*np.frombuffer(chunks([text])[0], "<u4")] == ids == [*np.frombuffer(model.encode_batch([text])[0], "<u4")]
    assert model.decode(chunks([text])[0]).decode() == library.decode(ids, skip_special_tokens=False)


def test_broken_bytes_decode_as_the_library_does(library):
    model, _ = bpe.model(PATH)
    for ids in ([220, 255, 130], [187], [94, 95, 96, 50256, 200]):
        assert model.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids, skip_special_tokens=False)


def test_token_file(spark, library, odd, odd_rows, tmp_path):
    tokenfile.write(odd, PATH, str(tmp_path / "t"), end_id=2)
    rows = tokenfile.read(spark, str(tmp_path / "t")).collect()
    rows.sort(key=lambda r: r.start)
    names = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert names == sorted(names) and len(rows) == len(odd_rows)
    n, want = 0, sorted(((-1 if i is None else i), tuple(ids_of(library, t) + [2])) for i, t in odd_rows)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.start == n and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids.tobytes())
        n += len(ids)
    assert sorted((a, tuple(np.frombuffer(r.ids, "<u4").tolist())) for a, r in zip(names, rows)) == want


def test_token_file_is_not_reordered_when_in_order(spark, library, odd_rows, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(odd_rows)], "doc_id long, text string").coalesce(1)
    tokenfile.write(docs, PATH, str(tmp_path / "t"), end_id=2)
    rows = sorted(tokenfile.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == list(range(len(odd_rows)))
    assert [[*np.frombuffer(r.ids, "<u4")] for r in rows] == [ids_of(library, t) + [2] for _, t in odd_rows]


def test_token_file_over_several_batches(spark, library, tmp_path):
    text = "the quick brown fox " * 60_000
    docs = spark.createDataFrame([(i, text + str(i)) for i in range(6)], "doc_id long, text string").coalesce(1)
    tokenfile.write(docs, PATH, str(tmp_path / "t"), end_id=2)
    rows = sorted(tokenfile.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == list(range(6)) and rows[5].start == sum(r.n_tokens for r in rows[:5])
    assert [*np.frombuffer(rows[3].ids, "<u4")] == ids_of(library, text + "3") + [2]


def test_empty(spark, empty, tmp_path):
    assert bpe.digests(empty, PATH).count() == 0
    tokenfile.write(empty, PATH, str(tmp_path / "t"), end_id=2)
    assert tokenfile.read(spark, str(tmp_path / "t")).count() == 0


def test_damage_is_seen(library):
    code = tokenfile.Code(tokenfile.code_lengths(np.bincount([1, 1, 2, 3])))
    block = bytearray(tokenfile.pack(code, [5, None], [2, 2], np.array([1, 1, 2, 3], np.uint32), 7))
    assert tokenfile.unpack(code, bytes(block))[0] == [5, None]
    block[-9] ^= 1
    with pytest.raises(ValueError):
        tokenfile.unpack(code, bytes(block))
