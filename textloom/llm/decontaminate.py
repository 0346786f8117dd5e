"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items, one scan of each text.

Texts are normalised bytewise (A-Z lowered, every ASCII character that is no letter or digit a separator), so a word's
place in the normalised text is its place in the original. The automaton works on word numbers: its alphabet is the
benchmark's vocabulary, and a document word outside it resets the scan.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import WORD_BYTES, Workspace, append, claim, id_text, map_rows

#: Words of one item in a window.
WINDOW = 10
#: Words of the benchmark in one automaton; a larger benchmark is scanned for in several blocks, each broadcast alone.
BLOCK_WORDS = 2_000_000
_SPAN = re.compile(rb"[^ ]+")


def words(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


class Windows:
    """The automaton of some items. An item with fewer words than a window, but not none, is one window."""

    def __init__(self, items: Iterable[tuple[str | None, str]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            own = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                owners[tuple(own[i : i + window])].add(item)
        self.finder = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, of in owners.items():
            self.finder.add_word(key, (len(key), tuple(of)))
        self.any = bool(owners)
        if self.any:
            self.finder.make_automaton()

    def scan(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Runs [start, end) of hit words, apart from each other and in order, and the items found."""
        runs: list[tuple[int, int]] = []
        items: set = set()
        if not self.any:
            return runs, items
        get = self.number.get
        for end, (size, of) in self.finder.iter(tuple([get(w, 0) for w in own])):
            items.update(of)
            start, end = end + 1 - size, end + 1
            while runs and runs[-1][1] >= start:  # ends ascend, starts needn't
                start = min(start, runs.pop()[0])
            runs.append((start, end))
        return runs, items


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of runs of words that don't overlap and ascend."""
    if not runs:
        return []
    raw = text.encode()
    at = [m.span() for m in _SPAN.finditer(raw.translate(WORD_BYTES))]
    out, done, chars = [], 0, 0
    for a, b in runs:
        ends = []
        for to in (at[a][0], at[b - 1][1]):
            chars += len(raw[done:to].decode())
            done = to
            ends.append(chars)
        out.append((ends[0], ends[1]))
    return out


def _blocks(bench: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items, ids as strings, in blocks of bounded size, one at a time on the driver. An item larger than a block is
    one alone."""
    out, size = [], 0
    own = bench.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    for item, text in own.toLocalIterator():
        n = len(text) // 5 + 1
        if out and size + n > most:
            yield out
            out, size = [], 0
        out.append((item, text))
        size += n
    yield out


def scan(docs: DataFrame, bench: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, places: bool = True) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and with `places` also text, items (sorted ids),
    starts and ends (characters of the text).

    A null text has no words and so no hits, like an empty one; items without text are in no window. Item ids of any
    type count as strings; rows that repeat an id are one item, and so are all items with a null id, which count but
    are named nowhere. Equal rows get equal results, each its own. An empty benchmark hits nothing; an empty table gives
    none. A window that several items share counts for each. A benchmark beyond `block_words` words is scanned for block
    by block; only ids and runs of what was hit are kept from each, and a document's are united afterwards.
    """
    base = id_text(docs, id_col, text_col)
    schema = "doc_id long,n_words long,n_hit long,n_items long,items_sha256 string,contaminated boolean"
    schema += ",text string,items array<string>,starts array<long>,ends array<long>" if places else ""
    blocks = _blocks(bench, item_id, item_text, block_words)
    first = next(blocks)
    more = next(blocks, None)
    if more is None:
        return map_rows(base, _scanner(first, window, places), schema)
    space = Workspace(docs.sparkSession, "decontaminate")
    rows, found = base.withColumn("digest", F.unhex(F.sha2("text", 256))), None
    for n, block in enumerate(chain((first, more), blocks)):
        own = map_rows(rows.select("digest", "text"), _finder(block, window), "digest binary,items array<string>,none boolean,a array<long>,b array<long>")
        hit = F.first(F.struct("items", "none", "a", "b")).alias("x")  # equal texts have equal hits
        own = space.save(own.groupBy("digest").agg(hit).select("digest", "x.*"), f"block{n}")
        found = own if found is None else found.unionByName(own)
    # a row for each text and block with hits
    united = found.groupBy("digest").agg(F.flatten(F.collect_list("items")).alias("items"), F.max("none").alias("none"), F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b"))
    return map_rows(rows.join(space.save(united, "united"), "digest", "left").drop("digest"), _finisher(places), schema)


def append_hits(docs: DataFrame, bench: DataFrame, name: str, *, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs as they are, with the number of hit words in a further column; nothing is shuffled. Several blocks add theirs
    one after another, so that a word hit in two counts twice; 0 still means that nothing was found. A null or empty
    text has none; rows that repeat get the same number each; an empty table or benchmark gives no hits."""
    total = None
    for n, block in enumerate(_blocks(bench, item_id, item_text, block_words)):
        own = f"{name}_{n}"

        def start(block: list[tuple[str | None, str]] = block) -> Callable[[list[str]], list[int]]:
            finder = _windows(block, window)
            return lambda texts: [sum(b - a for a, b in finder.scan(words(t))[0]) for t in texts]

        docs = append(docs, text_col, start, own, "long")
        total = F.col(own) if total is None else total + F.col(own)
    return docs.withColumn(name, total).drop(*[f"{name}_{i}" for i in range(n + 1)])


def _row(text: str, n: int, runs: list[tuple[int, int]], items: set, places: bool) -> tuple:
    named = sorted(x for x in items if x is not None)
    row = (n, sum(b - a for a, b in runs), len(items), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(runs))
    if not places:
        return row
    at = spans(text, runs)
    return (*row, text, named, [a for a, _ in at], [b for _, b in at])


_OUT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "text", "items", "starts", "ends")


def _columns(ids: list, rows: list[tuple], places: bool) -> dict[str, list]:
    names = _OUT if places else _OUT[:5]
    return {"doc_id": ids} | dict(zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True))


def _scanner(block: list[tuple[str | None, str]], window: int, places: bool):
    def run(batches):
        finder = _windows(block, window)
        for x in batches:
            rows = []
            for text in x["text"]:
                own = words(text)
                rows.append(_row(text, len(own), *finder.scan(own), places))
            yield _columns(x["doc_id"], rows, places)

    return run


def _finder(block: list[tuple[str | None, str]], window: int):
    """Hits of one block, by the text's digest; texts without any are left out."""

    def run(batches):
        finder = _windows(block, window)
        for x in batches:
            out: dict[str, list] = {"digest": [], "items": [], "none": [], "a": [], "b": []}
            for digest, text in zip(x["digest"], x["text"], strict=True):
                runs, items = finder.scan(words(text))
                if runs:
                    for to, value in zip(out.values(), (digest, [i for i in items if i is not None], None in items, [s for s, _ in runs], [e for _, e in runs]), strict=True):
                        to.append(value)
            yield out

    return run


def _finisher(places: bool):
    def run(batches):
        for x in batches:
            rows = []
            for text, items, none, a, b in zip(*(x[c] for c in ("text", "items", "none", "a", "b")), strict=True):
                runs: list[list[int]] = []
                for s, e in sorted(zip(a or (), b or (), strict=True)):
                    if runs and runs[-1][1] >= s:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([s, e])
                rows.append(_row(text, len(words(text)), runs, {*(items or ()), *([None] if none else ())}, places))
            yield _columns(x["doc_id"], rows, places)

    return run


_kept: list = [None, None]


def _windows(block: list[tuple[str | None, str]], window: int) -> Windows:
    """A Python worker keeps the last automaton that it has built."""
    claim("decontaminate", lambda: _kept.__setitem__(slice(None), [None, None]))
    key = hashlib.sha256(repr((block, window)).encode()).digest()
    if _kept[0] != key:
        _kept[:] = [key, Windows(block, window)]
    return _kept[1]
