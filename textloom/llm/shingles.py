"""Near copies by true Jaccard similarity of word shingles: SimHash finds candidates, each class is verified.

A text is its set of hashed shingles; equal sets are one node. A node has several SimHash fingerprints, each a majority
of the set's hashes after another mixing. Bands of their bits deal nodes to blocks, in which the bit-sliced comparison
of the near-dedup operator finds those whose first fingerprint is within RADIUS; the first two together must be within
BOTH. Two sets of similarity 0.8 agree in a bit with probability 1 - acos(2s/(1+s))/pi = 0.85 for large sets; there are
as many bands as leave out such a pair with probability MISS, and more alike ones less. As bits say little about small
sets, those of SMALL shingles or fewer (and what may be near them) also meet by their rarest shingles: such pairs share
one of the first n - 0.8n + 1 in any order, so none is lost.

Candidates are linked to stars, so there are no more links than nodes in a block; the sets of a component of such links
meet in one task (in parts that meet pairwise where it is large), where every two that aren't in one class yet and can
reach the least similarity by their prefixes are compared in full. No link is made that wasn't verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import Workspace, claim, id_text, join_by_key, map_rows
from textloom.llm.components import components, unite
from textloom.llm.exact import sieved
from textloom.llm.simhash import SEED, hashes, majority, name_classes, near, words

SHINGLE, LEAST = 5, 0.8
#: Shingles of a component that meet in one task; a larger component is cut into parts of about this size.
PART = 800_000
#: Nodes of a block that are compared at once; a larger block is cut into parts that meet pairwise.
BLOCK = 4096
#: Distance of the first fingerprint, and of the first two, up to which nodes are candidates.
RADIUS, BOTH = 23, 38
#: How often a bit of two sets of the least similarity agrees at least, and how often such a pair may be in no band.
AGREE, MISS = 0.84, 1e-3
#: Sets of so many shingles or fewer also meet by their rarest shingles.
SMALL = 32


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; fewer words than a shingle are one, no words are none."""
    return np.unique(hashes(words(text), shingle).view(np.int64))


def node(own: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED)], "<u8").view("<i8")[0])


def needed(n: int, least: float) -> int:
    """How many shingles a set of n must share with any set so similar."""
    return ceil(least * n - 1e-9)


def prefix(own: np.ndarray, often: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The shingles of which any set so similar has one in its own prefix."""
    if not len(own):
        return own
    rank = np.zeros(len(own), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
        rank = np.where(often[at] == own, counts[at], 0)
    return own[np.argsort(rank, kind="stable")[: len(own) - needed(len(own), least) + 1]]


def layout(rows: int) -> tuple[int, int]:
    """Bits in a band and number of bands for so many nodes: about 512 unlike ones share a band's bits by chance."""
    bits = max(6, ceil(log2(max(2, rows))) - 9)
    return bits, ceil(log(MISS) / log(1 - AGREE**bits))


def words_of(bits: int, many: int) -> int:
    """How many fingerprints the bands need; a band lies within one. The comparison needs two."""
    return max(2, -(-many // (64 // bits)))


def _mixers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1 << 62, dtype=np.uint64, size=n) * np.uint64(2) + np.uint64(1)


def fingerprints(own: np.ndarray, n: int) -> list[int]:
    """n fingerprints of a set; that of an empty one is 0."""
    out, h = [], own.view(np.uint64)
    for factor in _mixers(n) if len(own) else ():
        x = h * factor
        out.append(majority(x ^ x >> np.uint64(29)))
    return out or [0] * n


def band_key(prints: Column, band: int, bits: int) -> Column:
    """A band's number and its bits."""
    word, at = divmod(band, 64 // bits)
    return F.lit(band << 48) + F.shiftrightunsigned(prints[word], at * bits).bitwiseAND(F.lit((1 << bits) - 1))


def _rows(docs: DataFrame, shingle: int, least: float, many: int) -> DataFrame:
    """doc_id, text_key, node, n, its `many` fingerprints, and the shingles of small sets."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        claim("shingles")
        for x in batches:
            sets = [shingles(t, shingle) for t in x["text"]]
            yield {
                "doc_id": x["doc_id"], "text_key": x["text_key"], "node": [node(s) for s in sets], "n": [len(s) for s in sets],
                "prints": [np.array(fingerprints(s, many), np.uint64).view(np.int64) for s in sets],
                "small": [s if len(s) * least <= SMALL else [] for s in sets],
            }

    return map_rows(docs, run, "doc_id long,text_key long,node long,n long,prints array<long>,small array<long>")


def _near_in_bands(nodes: DataFrame, bits: int, many: int, total: int, space: Workspace) -> DataFrame:
    """a, b: stars of the nodes that a band's bits bring together and that are near by their fingerprints."""
    keys = F.array(*[band_key(F.col("prints"), b, bits) for b in range(many)])
    rows = nodes.where(F.col("n") > SMALL).select("node", F.col("prints")[0].alias("first"), F.col("prints")[1].alias("second"), F.explode(keys).alias("key"))
    full = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    full = space.save(full.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), "n"), "full")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    rows = join_by_key(rows, full, "key", total, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    groups = ["key", "i", "j"]
    rows = rows.select("node", "first", "second", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return map_rows(rows.repartition(*groups).sortWithinPartitions(*groups, "side"), _compared, "a long,b long")


def _compared(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    """Rows sorted by group in, a spanning star for each connected set of a group out."""
    held: list[np.ndarray] = []

    def compare(rows: np.ndarray) -> dict[str, list]:
        starts = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(rows)])
        place = np.arange(len(rows))
        last = np.repeat(starts + sizes, sizes)
        middle = np.repeat(starts + np.add.reduceat(1 - rows[:, 3], starts), sizes)  # where side 1 begins
        first = np.where(rows[:, 1] < rows[:, 2], middle, place + 1)
        last = np.where((rows[:, 1] < rows[:, 2]) & (rows[:, 3] == 1), first, last)
        root, prints = place.copy(), rows[:, 5:].view(np.uint64)
        for a, b in near(prints[:, 0], first, np.maximum(last, first), RADIUS):
            close = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1) <= BOTH
            unite(root, a[close], b[close])
        own = np.flatnonzero(root != place)
        return {"a": rows[own, 4], "b": rows[root[own], 4]}

    for x in batches:
        rows = np.concatenate([*held, np.array([x[c] for c in ("key", "i", "j", "side", "node", "first", "second")], np.int64).T])
        if len(rows):
            cut = int((rows[:, :3] != rows[-1, :3]).any(axis=1).nonzero()[0].max(initial=-1)) + 1
            held = [np.ascontiguousarray(rows[cut:])]
            if cut:
                yield compare(np.ascontiguousarray(rows[:cut]))
    if held:
        yield compare(held[0])


def _near_by_shingles(nodes: DataFrame, least: float, space: Workspace) -> DataFrame:
    """a, b: stars of the small sets that share one of their rarest shingles."""
    rows = space.save(nodes.select("node", "n", F.explode("small").alias("shingle")), "small")
    total = rows.count()
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).withColumn("often", F.col("n"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle"))
    prefix = F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9) + 1
    own = join_by_key(rows.withColumnRenamed("n", "size"), often, "shingle", total).withColumn("rank", rank)
    own = space.save(own.where((F.col("rank") <= prefix) & (F.col("often") > 1)).select("node", "shingle"), "rarest")
    heads = own.groupBy("shingle").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n"))
    return join_by_key(own, heads, "shingle", total).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))


def join(sets: list[np.ndarray], side: np.ndarray, least: float) -> np.ndarray:
    """root: root[x] is the same for all sets that links of similarity least or more join; where both sides are there,
    two sets of one side aren't compared (they meet elsewhere)."""
    size = np.array([len(s) for s in sets])
    root = np.arange(len(sets))
    both = 0 < side.sum() < len(side)
    shingle, count = np.unique(np.concatenate(sets), return_counts=True)
    shingle, count = shingle[count > 1], count[count > 1]
    tokens, of = [], []
    for x, s in enumerate(sets):
        p = prefix(s, shingle, count, least)
        at = np.searchsorted(shingle, p)
        at = at[(at < len(shingle)) & (shingle[np.minimum(at, len(shingle) - 1)] == p)] if len(shingle) else at[:0]
        tokens.append(at)
        of.append(np.full(len(at), x))
    token, doc = np.concatenate(tokens), np.concatenate(of)
    order = np.argsort(token, kind="stable")
    posting, ends = doc[order], np.cumsum(np.bincount(token, minlength=len(shingle)))
    for x, own in enumerate(tokens):
        seen = np.zeros(len(sets), bool)
        for t in own.tolist():
            seen[posting[ends[t - 1] if t else 0 : ends[t]]] = True
        seen[: x + 1] = False
        if both:
            seen &= side != side[x]
        seen &= np.minimum(size, size[x]) >= least * np.maximum(size, size[x]) - 1e-9
        seen &= root != root[x]
        near = np.flatnonzero(seen)
        while len(near):
            y, near = near[0], near[1:]
            shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if shared >= least * (size[x] + size[y] - shared) - 1e-9:
                a, b = sorted((root[x], root[y]))
                root[root == b] = a
                near = near[root[near] != root[x]]
    return root


def _verified(shingle: int, least: float):
    """Rows sorted by group in, verified links out: no more than rows."""

    def links(nodes: list[int], sides: list[int], sets: list[np.ndarray]) -> dict[str, list]:
        own, root = np.array(nodes, np.int64), join(sets, np.array(sides), least)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return {"a": own[linked], "b": own[root[linked]]}

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        group, held = None, ([], [], [])
        for x in batches:
            for c, i, j, side, own, text in zip(*(x[k] for k in ("class", "i", "j", "side", "node", "text")), strict=True):
                if (c, i, j) != group:
                    if held[0]:
                        yield links(*held)
                    group, held = (c, i, j), ([], [], [])
                for to, value in zip(held, (own, side, shingles(text, shingle)), strict=True):
                    to.append(value)
        if held[0]:
            yield links(*held)

    return run


def _dealt(members: DataFrame, part: int) -> DataFrame:
    """members (node, class, n, text) by the groups that meet: i = j within a part, i < j between two."""
    parts = members.groupBy("class").agg(F.ceil(F.sum("n") / part).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"))
    rows = join_by_key(members.select("node", "class", "text"), parts, "class", members.count()).withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("node", "text", "class", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def classes(docs: DataFrame, *, shingle: int = SHINGLE, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """doc_id, component_id (the smallest id that links of similarity least or more lead to), kept (one row of each
    class, with the smallest id), text_key, size (rows of the class).

    Words are cut at ASCII white space, A-Z is lowered. A null text counts as empty; texts without words are alike.
    Rows that repeat are each returned with the same class; null ids come last. An empty table gives none. Only the two
    named columns are read.
    """
    space, after = Workspace(docs.sparkSession, "shingles"), Workspace(docs.sparkSession, "shingle_links")
    texts = id_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    many = texts.count()
    bits, bands = layout(many)
    rows = space.save(_rows(texts, shingle, least, words_of(bits, bands)), "rows")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    about = [F.first(c).alias(c) for c in ("n", "prints", "small")]  # of equal sets these are equal
    nodes = space.save(rows.groupBy("node").agg(F.min(own).alias("least"), F.count(F.lit(1)).alias("rows"), *about), "nodes")
    found = components(_near_in_bands(nodes, bits, bands, many * bands, space).unionByName(_near_by_shingles(nodes, least, space)), space)
    of = found.select(F.col("a").alias("node"), F.col("b").alias("class")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("class")).distinct())
    named = nodes.join(of, "node").select("node", "class", "n", F.col("least.doc_id").alias("own_id"), F.col("least.text_key").alias("own_key"))
    # the text of one row of each node that has candidates; other texts stay where they are
    pair = lambda i, key: F.sha2(F.concat_ws("\t", F.coalesce(i.cast("string"), F.lit("none")), key.cast("string")), 256)
    named = space.save(named.select("node", "class", "n", F.unhex(pair(F.col("own_id"), F.col("own_key"))).alias("digest")), "candidates")
    some = sieved(texts.withColumn("digest", F.unhex(pair(F.col("doc_id"), F.col("text_key")))), named, named.count(), "maybe").where("maybe")
    members = space.save(some.dropDuplicates(["digest"]).join(named, "digest").select("node", "class", "n", "text"), "members")
    dealt = _dealt(members, part).repartition("class", "i", "j").sortWithinPartitions("class", "i", "j", "side", "node")
    joined = components(map_rows(dealt, _verified(shingle, least), "a long,b long"), after)
    total = nodes.count()
    nodes = nodes.select("node", "least", F.col("rows").alias("n"))
    named = after.save(name_classes(nodes, joined, "node", total, after), "named")
    return join_by_key(rows.select("doc_id", "text_key", "node"), named.withColumnRenamed("class_rows", "size"), "node", many).select(
        "doc_id", F.col("first.doc_id").alias("component_id"),
        (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_key") == F.col("text_key"))).alias("kept"), "text_key", "size",
    )
