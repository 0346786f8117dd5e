"""Byte-pair encoding and decoding without merging: an exact backtracking encoder over longest matches.

A sequence of tokens is what merging would give if and only if every two neighbours would stay apart when merged alone.
So the encoder takes the longest token at a place (all places' longest tokens come from one Aho-Corasick pass), checks
it against its left neighbour, tries shorter tokens if they don't fit, and steps back where none does. Each place is
given up at most once, which keeps the work linear. Decoding gathers bytes by an offset table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from textloom.llm.common import PieceEncoder, claim, id_text, map_rows, native_path

#: Pre-tokenization of byte-level BPE with contractions of English; fixed value of the file format ("use_regex").
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeModel:
    """A byte-level BPE vocabulary; tokens are numbered by rank inside: bytes first, then merges in order."""

    def __init__(self, path: str):
        with open(native_path(path), encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} is no byte-level BPE file")
        vocab: dict[str, int] = model["vocab"]
        of_byte = {b: c for c, b in letters.items()}
        names = [of_byte[b] for b in range(256)]
        rank = {x: i for i, x in enumerate(names)}
        self.pair: dict[tuple[int, int], int] = {}
        self.split: list[tuple[int, int]] = [(i, i) for i in range(256)]
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if (joined := a + b) in rank:
                raise ValueError(f"two merges make {joined!r}")
            self.pair[rank[a], rank[b]] = rank[joined] = len(names)
            self.split.append((rank[a], rank[b]))
            names.append(joined)
        raw = [bytes(letters[c] for c in x) for x in names]
        self.length = [len(x) for x in raw]
        self.ids = np.array([vocab[x] for x in names], "<u4")
        by_bytes = {x: i for i, x in enumerate(raw)}
        self.shorter = [next((by_bytes[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in by_bytes), -1) for x in raw]
        self.finder = ahocorasick.Automaton()
        for i, x in enumerate(raw):
            self.finder.add_word(x.decode("latin-1"), (len(x) - 1, i))
        self.finder.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("only plain added tokens are known")
        self.at_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.pieces = regex.compile(PIECES)
        contents = {int(i): x for i, x in zip(self.ids, raw, strict=True)} | {i: x.encode() for x, i in self.added.items()}
        sizes = np.zeros(max(contents) + 2, np.int64)
        for i, x in contents.items():
            sizes[i + 1] = len(x)
        self.offsets = np.cumsum(sizes)
        self.blob = np.frombuffer(b"".join(contents.get(i, b"") for i in range(len(sizes) - 1)), np.uint8)
        self.cached: dict[str, bytes] = {}

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b would leave exactly a, b: no merge across the border may come first."""
        pair, split = self.pair, self.split
        limit = len(split)
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            found = self.fits[a, b] = self._stay_apart(a, b)
        return found

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ranks of the tokens of one piece."""
        longest = [0] * len(data)
        for end, (before, token) in self.finder.iter(data.decode("latin-1")):
            longest[end - before] = token  # later ones end later
        open_, out, at, size = bytearray(b"\1" * (len(data) + 1)), [], 0, self.length
        token = longest[0] if data else -1
        while token >= 0:
            end = at + size[token]
            if open_[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < len(data) else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_[at] = 0
                token = out.pop()
                at -= size[token]
        return out

    def _encode_text(self, text: str) -> bytes:
        out, at, cached = [], 0, self.cached
        if len(cached) > 50_000:
            cached.clear()
        for m in [*self.at_added.finditer(text), None]:
            for piece in self.pieces.findall(text[at : m.start() if m else None]):
                ids = cached.get(piece)
                if ids is None:
                    ids = self.ids[self.encode_bytes(piece.encode())].tobytes() if piece else b""
                    if len(piece) <= 64:
                        cached[piece] = ids
                out.append(ids)
            if m:
                out.append(np.array([self.added[m[0]]], "<u4").tobytes())
                at = m.end()
        return b"".join(out)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids as packed little-endian unsigned 32-bit integers."""
        return [self._encode_text(x) for x in texts]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The same for letters with a space before them, each of which is one piece."""
        ids, encode = self.ids, self.encode_bytes
        return [ids[encode(b" " + x.encode())].tobytes() for x in words]

    def decode(self, ids: bytes) -> bytes:
        """The text of packed ids in UTF-8; broken sequences become U+FFFD."""
        at = np.frombuffer(ids, "<u4")
        first = self.offsets[at]
        size = self.offsets[at + 1] - first
        ends = np.cumsum(size)
        if not len(at) or not ends[-1]:
            return b""
        raw = self.blob[np.repeat(first - ends + size, size) + np.arange(ends[-1])].tobytes()
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def model(path: str) -> tuple[BpeModel, PieceEncoder]:
    """One to a Python worker."""
    found = BpeModel(path)
    return found, PieceEncoder(found.encode_batch, found.encode_words, most=200_000)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit integers), text (what the ids decode to).

    A null text counts as empty and gives no ids; rows with equal ids or texts are kept apart, each with its result; an
    empty table gives none. Texts of any length are encoded whole. Only the two named columns are read.
    """

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        claim("bpe", model.cache_clear)
        bpe, chunks = model(path)
        for x in batches:
            ids = chunks(x["text"])
            yield {"doc_id": x["doc_id"], "n_tokens": [len(i) // 4 for i in ids], "ids": ids, "text": [bpe.decode(i).decode() for i in ids]}

    return map_rows(id_text(docs, id_col, text_col), run, "doc_id long,n_tokens long,ids binary,text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, made where the ids are so that they needn't travel."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        claim("bpe", model.cache_clear)
        bpe, chunks = model(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for x in batches:
            ids = chunks(x["text"])
            yield {"doc_id": x["doc_id"], "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [sha(i) for i in ids], "decoded_sha256": [sha(bpe.decode(i)) for i in ids]}

    return map_rows(id_text(docs), run, "doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string")
