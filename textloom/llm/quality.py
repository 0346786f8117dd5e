"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with a temperature.

Each token is read in three ways: as a word, as a shape (cases, digits, marks and their repeats, length) and as its
place among what was said before (repeats of words and pairs). Each of the VOCABULARY most frequent words of all
documents is a unit of its own; rarer words, which a pooled vector hardly shows, share BUCKETS units by their hash, as
shapes share SHAPES. A unit has a sparse random index vector, and its word vector sums the index vectors of its
neighbours over all documents. A document is the mean of its units' vectors, a stretch for each reading.

As most distinct tokens are rare, nothing is remembered of tokens: words, shapes and repeats are told by hashes that are
differences of running sums over characters, so that all tokens of many texts are read at once by arrays.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Workspace, append, claim, fold_col, id_text, map_rows, trim

#: Words that are units of their own, units of all other words, of shapes and of repeats.
VOCABULARY, BUCKETS, SHAPES, REPEATS = 16_384, 2048, 960, 64
WORDS, FORMS = VOCABULARY + BUCKETS, SHAPES + REPEATS
#: Entries of a vector, and how many of an index vector are not 0.
WIDTH, FILLED = 64, 6
FEATURES = 3 * WIDTH + 4
#: Bound on labelled rows that the network is fitted on.
TRAIN = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 48, 60, 3e-3, 1e-4
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Characters that are read at once, and of texts whose tokens are held at once; a longer text is read in pieces.
PIECE, CHUNK = 1 << 15, 1 << 20


def index_vectors(seed: int, units: int) -> np.ndarray:
    """Each unit's ternary vector."""
    rng = np.random.default_rng(seed)
    out = np.zeros((units, WIDTH), np.int8)
    at = rng.random((units, WIDTH)).argpartition(FILLED, axis=1)[:, :FILLED]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.int8), (units, FILLED)), axis=1)
    return out


class _Kinds(dict):
    """For str.translate: capital, small, digit and other letters as A, a, 0, o; marks as they are."""

    def __missing__(self, c: int) -> str:
        x = chr(c)
        self[c] = "A" if x.isupper() else "a" if x.islower() else "0" if x.isdigit() else "o" if x.isalpha() else x
        return self[c]


_kinds = _Kinds()


#: A word of Latin letters, small but for the first, and marks after it.
_PLAIN = re.compile(r"([A-ZÀ-ÖØ-Þ])?[a-zß-öø-ÿ]+([!-/:-@\[-`{-~]*)")


def shape(token: str) -> str:
    """Kinds of all its characters, runs of letters once, and the length, roughly."""
    if m := _PLAIN.fullmatch(token):  # as below, but at once
        kinds = ("Aa" if m[1] else "a") + m[2]
    else:
        kinds = token.translate(_kinds)
        for c in "Aa0o":
            while c + c in kinds:
                kinds = kinds.replace(c + c, c)
    n = len(token)
    return f"{kinds}{n if n < 4 else 4 if n < 9 else 5 if n < 16 else 6 if n < 32 else 7}"


_AROUND = ".,;:!?()\"'"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers as 64 bits that look random (SplitMix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _characters(codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of characters: whether they are white space, whether they go from a word's ends, and numbers for themselves, for
    their small letters and for their kinds; and whether runs of the kind count once."""
    own = list(map(chr, codes.tolist()))
    low = [ord(x.lower()) if len(x.lower()) == 1 else ord(x) for x in own]
    kind = [ord(x.translate(_kinds)) for x in own]
    runs = np.isin(kind, [ord(c) for c in "Aa0o"])
    return np.array([x.isspace() for x in own], bool), np.array([x in _AROUND for x in own], bool), _mixed(codes), _mixed(np.array(low, np.int64)), _mixed(np.array(kind, np.int64)), runs


#: Of the first 65,536 characters; powers of an odd number and of its inverse modulo 2^64.
_table: list[np.ndarray] = []
_BASE = 0x5851F42D4C957F2D
_POWER, _INVERSE = (np.r_[np.uint64(1), np.full(2 * PIECE + 1, x, np.uint64)].cumprod(dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _before(x: np.ndarray) -> np.ndarray:
    """Sums of all that stand before each place, and of all."""
    out = np.zeros(len(x) + 1, np.int64 if x.dtype == bool else x.dtype)
    np.cumsum(x, out=out[1:])
    return out


def _tokens(text: str, only_words: bool) -> tuple[np.ndarray, ...]:
    """Where each token of a piece begins and ends, and hashes of its word and, unless only words are asked for, of
    itself and of its shape."""
    if not _table:
        _table.extend(_characters(np.arange(1 << 16)))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(code) and code.max() >= 1 << 16:
        far, at = np.unique(code, return_inverse=True)
        space, around, own, low, kind, runs = (x[at] for x in _characters(far))
    else:
        space, around, own, low, kind, runs = (x[code] for x in _table)
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    begin, end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    n = len(code)
    power = _POWER[:n]
    small = _before(low * power)
    inside = ~(space | around)
    at, count = np.flatnonzero(inside), _before(inside)
    some = count[end] > count[begin]
    first, last = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    first[some], last[some] = at[count[begin[some]]], at[count[end[some]] - 1] + 1
    words = _mixed((small[last] - small[first]) * _INVERSE[first])
    if only_words:
        for i in np.flatnonzero(end - begin > PIECE).tolist():
            words[i] = _long(text[begin[i] : end[i]])[0]
        return begin, end, words, words, words
    raw = _before(own * power)
    itself = _mixed((raw[end] - raw[begin]) * _INVERSE[begin])
    shown = ~space
    shown[1:] &= ~(runs[1:] & (kind[1:] == kind[:-1]))
    at, count = np.flatnonzero(shown), _before(shown)
    shapes = _before(kind[at] * power[: len(at)])
    size = end - begin
    length = np.searchsorted([4, 9, 16, 32], size, "right") + np.minimum(size, 3)
    shapes = _mixed((shapes[count[end]] - shapes[count[begin]]) * _INVERSE[count[begin]] + length.astype(np.uint64))
    for i in np.flatnonzero(size > PIECE).tolist():
        words[i], itself[i], shapes[i] = _long(text[begin[i] : end[i]])
    return begin, end, words, itself, shapes


def _long(token: str) -> tuple[int, int, int]:
    """The three hashes of a token longer than PIECE."""
    hashed = lambda x: xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
    inner = token.strip(_AROUND)
    short = int(Read([inner]).words[0]) if 0 < len(inner) <= PIECE else int(_mixed(np.zeros(1))[0])
    return hashed(inner.lower()) if len(inner) > PIECE else short, hashed(token), hashed(shape(token))


_SPACE = re.compile(r"\s")


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces between tokens, of about PIECE characters; a token longer than PIECE may be one."""
    at = 0
    while at < len(text):
        cut = m.start() if (m := _SPACE.search(text, at + PIECE)) else len(text)
        if cut - at <= 2 * PIECE:
            yield text[at:cut]
        else:  # it ends in such a token
            yield from text[at:cut].rsplit(None, 1)
        at = cut


class Read:
    """All tokens of many texts: hashes of words and of the tokens themselves, numbers of shapes, whether they are longer
    than three, and where each text's tokens end. Without `shapes` (hashes that are known) just words and ends count."""

    def __init__(self, texts: list[str], shapes: dict[int, int] | None = None):
        parts: list[tuple] = []
        ends: list[np.ndarray] = []
        self.shapes, count, batch, held = shapes, 0, [], 0

        def read(piece: str, bounds: np.ndarray | None = None) -> None:
            nonlocal count
            if len(piece) > 2 * PIECE:
                w, own, s = _long(piece)
                parts.append((np.array([w], np.uint64), np.array([own], np.uint64), self._forms(np.array([s], np.uint64), lambda i: piece), np.array([True])))
                count += 1
                return
            begin, end, words, itself, shaped = _tokens(piece, shapes is None)
            parts.append((words, itself, self._forms(shaped, lambda i: piece[begin[i] : end[i]]), end - begin > 3))
            if bounds is not None:
                ends.append(count + np.searchsorted(begin, bounds))
            count += len(begin)

        def flush() -> None:
            nonlocal batch, held
            if batch:
                read("\n".join(batch), np.cumsum([len(t) + 1 for t in batch]))
            batch, held = [], 0

        for text in texts:
            if held + len(text) >= PIECE:
                flush()
            if len(text) >= PIECE:
                for piece in _pieces(text):
                    read(piece)
                ends.append(np.array([count]))
            else:
                batch.append(text)
                held += len(text) + 1
        flush()
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, x) for x in (np.uint64, np.uint64, np.int64, bool)]
        self.words, self.itself, self.forms, self.longer = columns
        self.ends = np.concatenate([np.zeros(0, np.int64), *ends])

    def _forms(self, shaped: np.ndarray, token: Callable[[int], str]) -> np.ndarray:
        """Numbers of shapes: each distinct one is spelled out once."""
        if self.shapes is None:
            return shaped
        own, first, at = np.unique(shaped, return_index=True, return_inverse=True)
        out = np.zeros(len(own), np.int64)
        for k, (h, i) in enumerate(zip(own.tolist(), first.tolist(), strict=True)):
            if (of := self.shapes.get(h)) is None:
                of = zlib.crc32(shape(token(i)).encode("utf-8", "surrogatepass")) % SHAPES
                if len(self.shapes) < 300_000:
                    self.shapes[h] = of
            out[k] = of
        return out[at]


def word(token: str) -> int:
    """A number for a token's word: small letters, without marks around it."""
    return int(Read([token]).words.view(np.int64)[0])


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """From where to where texts are read at once."""
    at = held = 0
    for i, t in enumerate(texts):
        if i > at and (held + len(t) > CHUNK or i - at == 512):
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word stands in all documents; summed in each task first."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, np.ndarray]]:
        claim("quality counts")
        words, n, fresh, many = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            every, times = np.concatenate([words, *fresh]), np.concatenate([n, np.ones(many, np.int64)])
            if not len(n):
                return np.unique(every, return_counts=True)
            order = np.argsort(every)
            every = every[order]
            starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            return every[starts], np.add.reduceat(times[order], starts)

        for x in batches:
            for a, b in chunks(x["text"]):
                fresh.append(Read(x["text"][a:b]).words.view(np.int64))
                many += len(fresh[-1])
                if many > 1_000_000:
                    words, n = summed()
                    fresh, many = [], 0
                    if len(words) > 1_000_000:
                        yield {"word": words, "n": n}
                        words, n = words[:0], n[:0]
        if many or len(words):
            words, n = summed()
            yield {"word": words, "n": n}

    return map_rows(docs.select("text"), run, "word long,n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, most: int = VOCABULARY) -> dict[int, int]:
    """Numbers of the most frequent words: all that stand so often that they are at most `most`, counts taken in steps
    of a twentieth; nothing else of the counts comes to the driver."""
    step = F.floor(F.log("n") * 20)
    room, least = most, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    own = counts.where(step >= least).select("word").collect() if least is not None else []
    return {w: i for i, w in enumerate(sorted(r["word"] for r in own))}


class Reader:
    """Turns texts into units."""

    def __init__(self, number: dict[int, int]):
        self.keys = np.array(sorted(number), np.int64)
        self.at = np.array([number[k] for k in self.keys.tolist()], np.int64)
        # by the first bits of a word, where the search in keys begins
        self.heads = np.searchsorted(self.keys, (np.arange((1 << 16) + 1) - (1 << 15)).clip(max=(1 << 15) - 1) << 48)
        self.heads[-1] = len(self.keys)
        self.deep = int(np.diff(self.heads).max(initial=0))
        self.shapes: dict[int, int] = {}

    def _units(self, words: np.ndarray) -> np.ndarray:
        out = VOCABULARY + words % BUCKETS
        head = (words >> 48) + (1 << 15)
        at, last = self.heads[head], self.heads[head + 1]
        live = np.flatnonzero(at < last)
        for step in range(self.deep):
            place = at[live] + step
            hit = self.keys[place] == words[live]
            out[live[hit]] = self.at[place[hit]]
            live = live[~hit & (place + 1 < last[live])]
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Units of all tokens of all texts: words (below WORDS), shapes and repeats (below FORMS); where each text ends."""
        read = Read(texts, self.shapes)
        n, of = len(read.words), read.itself
        start = np.repeat(np.r_[0, read.ends[:-1]], np.diff(read.ends, prepend=0)) if len(read.ends) else read.ends
        # how long ago a word stood, and whether the word before it stood there then too
        bits = np.uint64(max(1, n.bit_length()))
        key = np.sort(of >> bits << bits | np.arange(n, dtype=np.uint64))
        order = (key & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
        before = np.full(n, -1, np.int64)
        same = key[1:] >> bits == key[:-1] >> bits
        before[order[1:][same]] = order[:-1][same]
        before[before < start] = -1
        gap = np.where(before >= 0, np.arange(n) - before, 0)
        again = np.zeros(n, np.int64)
        again[1:] = (before[1:] > start[1:]) & (of[np.maximum(before[1:] - 1, 0)] == of[:-1])
        step = np.frexp(gap.astype(np.float64))[1]  # 0 for none, else 1 + log2
        return self._units(read.words.view(np.int64)), read.forms, SHAPES + np.minimum(step, 15) * 4 + again * 2 + read.longer, read.ends


class _Sums:
    """Sums of neighbours' index vectors: words beside a word and its own shape, shapes beside a shape and its repeat,
    and the shapes of a repeat."""

    def __init__(self):
        self.words, self.forms = np.zeros((WORDS, WIDTH), np.int64), np.zeros(FORMS * FORMS, np.int64)
        # of no word, none
        self.of_words, self.of_forms = np.concatenate([index_vectors(11, WORDS), np.zeros((1, WIDTH), np.int8)]), index_vectors(12, FORMS)

    def add(self, w: np.ndarray, s: np.ndarray, r: np.ndarray, ends: np.ndarray) -> None:
        if not len(w):
            return
        inner = np.ones(len(w), bool)  # whether the token before is of the same document
        inner[0] = False
        inner[ends[ends < len(w)]] = False
        pairs = [s[:-1][inner[1:]] * FORMS + s[1:][inner[1:]], r * FORMS + s]
        self.forms += np.bincount(np.concatenate(pairs), minlength=len(self.forms))
        order = np.sort(w << 40 | np.arange(len(w))) & (1 << 40) - 1
        for at in range(0, len(w), 200_000):
            part = order[at : at + 200_000]
            own = w[part]
            near = self.of_forms.take(s[part], axis=0)
            near += self.of_words.take(np.where(inner[part], w[part - 1], WORDS), axis=0)
            after = np.minimum(part + 1, len(w) - 1)
            near += self.of_words.take(np.where(inner[after] & (after > part), w[after], WORDS), axis=0)
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            self.words[own[starts]] += np.add.reduceat(near, starts, axis=0, dtype=np.int32)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        pairs, index = self.forms.reshape(FORMS, FORMS).astype(np.float64), self.of_forms.astype(np.float64)
        total = np.concatenate([self.words.astype(np.float64), pairs @ index + pairs.T @ index])
        used = np.flatnonzero(total.any(axis=1))
        return used, total[used]


@dataclass
class Vectors:
    number: dict[int, int]
    words: np.ndarray
    forms: np.ndarray


def word_vectors(docs: DataFrame, number: dict[int, int]) -> Vectors:
    """Each unit's neighbours' index vectors summed over all documents, centred and at unit length, by reading.

    A task sends a row for each unit at most. Counts are whole numbers, so nothing is lost however many are summed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(number)  # VOCABULARY entries

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        sums, reader = _Sums(), _reader(shared.value)
        for x in batches:
            for a, b in chunks(x["text"]):
                sums.add(*reader(x["text"][a:b]))
        used, total = sums.rows()
        yield {"unit": used, "vector": list(total)}

    got = map_rows(docs.select("text"), run, "unit long,vector array<double>")
    sums = got.groupBy("unit").agg(*[F.sum(F.col("vector")[i]).alias(f"v{i}") for i in range(WIDTH)]).toPandas()
    out = np.zeros((WORDS + FORMS, WIDTH))
    if len(sums):
        out[sums["unit"].to_numpy(np.int64)] = sums.drop(columns="unit").to_numpy()
    own = np.concatenate([index_vectors(11, WORDS), index_vectors(12, FORMS)])
    for a, b in ((0, WORDS), (WORDS, WORDS + SHAPES), (WORDS + SHAPES, WORDS + FORMS)):
        norm = np.linalg.norm(out[a:b], axis=1, keepdims=True)
        unit = out[a:b] / np.where(norm > 0, norm, 1)
        unit -= unit.sum(axis=0) / max(1, (norm > 0).sum())
        # a unit's own index vector keeps apart units with the same neighbours
        out[a:b] = np.where(norm > 0, unit, 0) + own[a:b] / np.sqrt(FILLED)
    return Vectors(number, out[:WORDS].astype(np.float32), out[WORDS:].astype(np.float32))


_kept: list = [None, None]


def _reader(number: dict[int, int]) -> Reader:
    """A Python worker keeps the vocabulary's table and the shapes that it knows while the vocabulary is the same."""
    claim("quality", lambda: _kept.__setitem__(slice(None), [None, None]))
    if _kept[0] != number:
        _kept[:] = [number, Reader(number)]
    return _kept[1]


def features(texts: list[str], vectors: Vectors) -> np.ndarray:
    """Means of units' vectors by reading, and the length."""
    out, reader = np.zeros((len(texts), FEATURES), np.float32), _reader(vectors.number)
    for at, to in chunks(texts):
        part = texts[at:to]
        w, s, r, ends = reader(part)
        size = np.diff(ends, prepend=0)
        of = np.repeat(np.arange(len(part)) * FORMS, size)
        counts = np.bincount(np.concatenate([of + s, of + r]), minlength=len(part) * FORMS).reshape(len(part), FORMS)
        counts = (counts / np.maximum(size, 1)[:, None]).astype(np.float32)
        for i, (b, n, text) in enumerate(zip(ends.tolist(), size.tolist(), part, strict=True), at):
            if n:
                # in stretches, so that a long text doesn't gather all its vectors at once
                out[i, :WIDTH] = sum((np.ones(min(4096, b - j), np.float32) @ vectors.words.take(w[j : min(b, j + 4096)], axis=0)).astype(np.float64) for j in range(b - n, b, 4096)) / n
            n, words = len(text), text.count(" ") + 1
            out[i, -4:] = np.log1p(n) / 8, np.log1p(words) / 8, n / words / 16, text.count("\n") / words
        for k, (a, b) in enumerate(((0, SHAPES), (SHAPES, FORMS)), 1):
            out[at:to, k * WIDTH : (k + 1) * WIDTH] = counts[:, a:b] @ vectors.forms[a:b]
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def _loss(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logit) - y * logit))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam over mini-batches; a fifth of the rows choose the epoch and the temperature. One class alone is its share."""
    y = y.astype(np.float64)
    rng = np.random.default_rng(3)
    width = x.shape[1]
    mean = x.mean(axis=0, dtype=np.float64) if len(x) else np.zeros(width)
    z = x - mean  # the only copy of all rows
    scale = np.sqrt(np.einsum("ij,ij->j", z, z) / len(x)) + 1e-3 if len(x) else np.ones(width)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(y) < 20 or y.min() == y.max():
        return Network(mean, scale, np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), bias)
    order = rng.permutation(len(x))
    check, own = order[: len(x) // 5], order[len(x) // 5 :]
    p = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.array(bias)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z /= scale
    best, kept = np.inf, [a.copy() for a in p]
    for _ in range(EPOCHS):
        rng.shuffle(own)
        for at in range(0, len(own), 256):
            i = own[at : at + 256]
            h = np.tanh(z[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[i]) / len(i)
            back = np.outer(d, p[2]) * (1 - h * h)
            t += 1
            for k, g in enumerate((z[i].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ d + DECAY * p[2], d.sum())):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        loss = _loss(np.tanh(z[check] @ p[0] + p[1]) @ p[2] + p[3], y[check])
        if loss < best:
            best, kept = loss, [a.copy() for a in p]
    net = Network(mean, scale, kept[0], kept[1], kept[2], float(kept[3]))
    logit = net.logit(x[check])
    net.temperature = float(min(np.geomspace(0.25, 8, 81), key=lambda c: _loss(logit / c, y[check])))
    return net


def learn(docs: DataFrame, labels: DataFrame, vectors: Vectors, *, train: int = TRAIN) -> Network:
    """docs as of id_text(). At most `train` labelled rows outside the fold HELD_OUT, chosen by a hash of their ids; of
    rows that repeat an id the alphabetically first text."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    own = own.where(fold_col(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # WORDS + FORMS rows

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for x in batches:
            yield {"doc_id": x["doc_id"], "quality": x["quality"], "x": [f.tobytes() for f in features(x["text"], shared.value)]}

    rows = docs.join(F.broadcast(own), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # `train` rows of ids at most
    got = map_rows(rows, run, "doc_id long,quality int,x binary").toPandas().sort_values("doc_id")
    x = np.array([np.frombuffer(b, np.float32) for b in got["x"]]) if len(got) else np.zeros((0, FEATURES), np.float32)
    y = got["quality"].to_numpy(np.float64)
    del got
    return fit(x, y)


def append_score(docs: DataFrame, labels: DataFrame, name: str, *, id_col: str = "doc_id", text_col: str = "text", train: int = TRAIN) -> DataFrame:
    """docs as they are, with their scores in a further column, row by row in place. A null text counts as empty; rows
    that repeat get the same score each; an empty table gives none. `score` says which labels count."""
    base = id_text(docs, id_col, text_col)
    space = Workspace(docs.sparkSession, "quality")
    vectors = word_vectors(base, vocabulary(space.save(word_counts(base), "counts")))
    space.close()
    shared = docs.sparkSession.sparkContext.broadcast((vectors, learn(base, labels, vectors, train=train)))
    trim()  # the driver, too

    def start() -> Callable[[list[str]], np.ndarray]:
        vectors, net = shared.value
        return lambda texts: net.probability(features(texts, vectors).astype(np.float64))

    return append(docs, text_col, start, name, "double")


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train: int = TRAIN) -> DataFrame:
    """doc_id, held_out, score (probability of quality 1), predicted (score >= THRESHOLD): one row for each row of docs.

    A null text counts as empty and is scored like any other. Rows that repeat get the same score each; null ids are in
    no fold and have no label; labels that repeat an id count once, as the largest; labels other than 0 and 1 don't
    count. Without labels of both kinds the score is the labels' share. An empty table gives none. Word vectors are
    learned from all texts, whole; of docs and labels only the named columns are read.
    """
    rows = append_score(id_text(docs, id_col, text_col), labels, "score", train=train)
    held_out = fold_col(F.col("doc_id"), FOLDS) == HELD_OUT
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
