"""SimHash near-dedup: fingerprints of word shingles, bit-sliced comparison in blocks, connected components.

Fingerprints are compared once each, however many documents share them. They are dealt to blocks by some of their bits
so that two within the radius surely meet (pigeonhole), and a block's fingerprints are stored by bit plane: word w of
plane b holds bit b of 64 fingerprints. One query against such a word is a unit; carry-save counters update the 64
distances of many units at once, and a unit is abandoned when all its distances exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import LOWER_BYTES, Workspace, id_text, join_by_key, map_rows
from textloom.llm.components import components, unite

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a block that are compared at once; a larger block is cut into parts of about this size, and each two
#: parts are compared apart.
PART = 4096
#: Units in flight.
SLAB = 32_768


def words(text: str) -> list[bytes]:
    return text.encode().translate(LOWER_BYTES).split()


_LOW = np.uint64(0x0101010101010101)


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as an unsigned number.

    Each byte of a word counts one bit in turn; 255 words are added before a byte could run over.
    """
    counts, at = np.empty(64, np.int64), np.arange(0, len(h), 255)
    for j in range(8):
        counts[j::8] = np.add.reduceat(h >> np.uint64(j) & _LOW, at).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def hashes(own: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """A hash for each shingle, repeats included; fewer words than a shingle are one, no words are none."""
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    starts = [0, *accumulate(len(w) + 1 for w in own)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[min(shingle, len(own)) :], strict=False)], np.uint64)


def fingerprint(own: list[bytes], shingle: int = SHINGLE) -> int:
    """The majority of each bit over all shingles' hashes, as an unsigned number; 0 without words."""
    return majority(hashes(own, shingle)) if own else 0


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (its 64 bits as a signed long), text_key (tells apart texts of one id); a null text is empty
    and has fingerprint zero."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for x in batches:
            prints = np.array([fingerprint(words(t), shingle) for t in x["text"]], "<u8")
            yield {"doc_id": x["doc_id"], "fingerprint": prints.view("<i8"), "text_key": x["text_key"]}

    rows = id_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    return map_rows(rows, run, "doc_id long,fingerprint long,text_key long")


def keys(bits: int, parts: int, match: int) -> list[int]:
    """Masks of all choices of `match` of `parts` runs of bits. Two fingerprints that differ in `parts - match` bits at
    most agree under one mask at least."""
    edges = [bits * i // parts for i in range(parts + 1)]
    runs = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(runs, match)]


def choice(rows: int, radius: int) -> list[int]:
    """Masks for so many fingerprints: as few bits as leave blocks small. Every choice finds every pair in the radius."""
    match = 1
    while 64 * match // (radius + match) < np.log2(max(2, rows)) - 9 and match < 4:
        match += 1
    return keys(64, radius + match, match)


def _dealt(prints: DataFrame, masks: list[int], part: int, total: int, space: Workspace) -> DataFrame:
    """fingerprint, band, key, i, j, side: the groups to compare; i = j within a part, i < j between two."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    band = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for n, m in enumerate(signed)])).alias("x")
    rows = prints.select("fingerprint", band).select("fingerprint", "x.band", "x.key")
    full = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part)
    full = space.save(full.select("band", "key", F.ceil(F.col("n") / part).cast("int").alias("parts"), "n"), "full")
    own: Column = F.pmod(F.xxhash64("fingerprint", F.lit(1)), F.col("parts")).cast("int")
    rows = join_by_key(rows, full, ["band", "key"], total, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.select("fingerprint", "band", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return rows.select("fingerprint", "band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def near(prints: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b) of prints within the radius, b from first[a] to last[a] - 1; in slabs."""
    n = len(prints)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    padded = np.zeros(-(-n // 64) * 64, np.uint64)
    padded[:n] = prints
    planes = [np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8") for b in range(64)]
    whole = [np.where(prints >> np.uint64(b) & np.uint64(1), ones, np.uint64(0)) for b in range(64)]
    some = np.flatnonzero(last > first)
    begin, end = first[some] // 64, (last[some] - 1) // 64 + 1
    sizes = end - begin
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    width = (radius + 1).bit_length()
    start = (1 << width) - 1 - radius  # so that the counter overflows at radius + 1
    for at in range(0, total, SLAB):
        unit = np.arange(at, min(total, at + SLAB))
        of = np.searchsorted(before, unit, "right") - 1
        query, word = some[of], begin[of] + unit - before[of]
        low = np.clip(first[query] - word * 64, 0, 64).astype(np.uint64)
        high = np.clip(last[query] - word * 64, 0, 64).astype(np.uint64)
        below = lambda k: np.where(k >= 64, ones, (np.uint64(1) << (k & np.uint64(63))) - np.uint64(1))
        gone = ~(below(high) & ~below(low))
        counter = [np.full(len(unit), ones if start >> i & 1 else 0, np.uint64) for i in range(width)]
        for b in range(0, 64, 2):
            x, y = planes[b][word] ^ whole[b][query], planes[b + 1][word] ^ whole[b + 1][query]
            odd = x ^ y
            carry = (x & y) | (odd & counter[0])
            counter[0] ^= odd
            for c in counter[1:]:
                carry, c[:] = c & carry, c ^ carry
            gone |= carry
            if b % 8 == 6:
                live = gone != ones
                if (left := int(live.sum())) < 0.8 * len(live):
                    if not left:
                        break
                    query, word, gone, counter = query[live], word[live], gone[live], [c[live] for c in counter]
        else:
            bits = np.unpackbits((~gone).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            u, lane = np.nonzero(bits)
            yield query[u], word[u] * 64 + lane


def _links(radius: int):
    """Rows sorted by group in, a spanning star for each connected set of a group out: no more links than rows."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        held: list[np.ndarray] = []
        for x in batches:
            rows = np.array([x[c] for c in ("band", "key", "i", "j", "side", "fingerprint")], np.int64).T
            rows = np.concatenate([*held, rows])
            if not len(rows):
                continue
            cut = int((rows[:, :4] != rows[-1, :4]).any(axis=1).nonzero()[0].max(initial=-1)) + 1
            held = [rows[cut:]]
            if cut:
                yield compare(rows[:cut])
        if held and len(held[0]):
            yield compare(held[0])

    def compare(rows: np.ndarray) -> dict[str, list]:
        starts = np.flatnonzero(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
        ends = np.r_[starts[1:], len(rows)]
        group = np.repeat(np.arange(len(starts)), ends - starts)
        place = np.arange(len(rows))
        last = ends[group]
        apart = rows[:, 2] < rows[:, 3]
        middle = (starts + np.add.reduceat(1 - rows[:, 4], starts))[group]  # where side 1 begins; rows are sorted by side
        first = np.where(apart, middle, place + 1)
        last = np.where(apart & (rows[:, 4] == 1), first, last)
        root = np.arange(len(rows))
        for a, b in near(rows[:, 5].astype(np.uint64), first, np.maximum(last, first), radius):
            unite(root, a, b)
        own = np.flatnonzero(root != place)
        return {"a": rows[own, 5], "b": rows[root[own], 5]}

    return run


def classes(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hexadecimal digits), component_id (the smallest id that links lead to), kept
    (one row of each class, with the smallest id), text_key.

    A null text counts as empty; texts without words have fingerprint zero and are linked like any other. Fewer words
    than a shingle are one shingle. Rows that repeat are each returned with the same class; null ids are passed over
    when a class is named, unless it has no other. An empty table gives none. Only the two named columns are read.
    """
    space = Workspace(docs.sparkSession, "simhash")
    rows = space.save(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "rows")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")  # null ids come last
    prints = space.save(rows.groupBy("fingerprint").agg(F.min(own).alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    total = prints.count()
    joined = links(prints, choice(total, radius), radius, part, total, space)
    joined = components(joined, space)
    named = space.save(name_classes(prints, joined, "fingerprint", total, space), "named")
    return join_by_key(rows, named, "fingerprint", rows.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"),
        (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_key") == F.col("text_key"))).alias("kept"), "text_key",
    )


def links(prints: DataFrame, masks: list[int], radius: int, part: int, total: int, space: Workspace) -> DataFrame:
    """a, b: links that join fingerprints within the radius; no more in a block than it has fingerprints."""
    groups = ["band", "key", "i", "j"]
    dealt = _dealt(prints, masks, part, total * len(masks), space)
    dealt = dealt.repartition(*groups).sortWithinPartitions(*groups, "side", "fingerprint")
    return map_rows(dealt, _links(radius), "a long,b long")


def name_classes(nodes: DataFrame, joined: DataFrame, node: str, total: int, space: Workspace) -> DataFrame:
    """node, first, n, class_rows: nodes (with least and n, their rows), the smallest `least` of all that links join with
    each, and the rows of these."""
    of = nodes.join(joined.withColumnRenamed("a", node), node, "left").select(node, "least", F.coalesce("b", node).alias("class"), F.col("n").alias("rows"))
    of = space.save(of, "of")
    first = of.groupBy("class").agg(F.min("least").alias("first"), F.sum("rows").alias("class_rows"), F.count(F.lit(1)).alias("n"))
    return join_by_key(of, first, "class", total).select(node, "first", F.col("rows").alias("n"), "class_rows")
