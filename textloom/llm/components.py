"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is two grouped minima and joins; the table of links never grows and nothing of it comes to the driver but
a count and a checksum. Tables between rounds lie in the shared folder.

A table of FEW links or fewer is united by one task instead: rounds are some hundred query stages whatever the table's
size, and planning these is most of the driver's memory where tables are small. The components are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Workspace, join_by_key, map_rows

#: Links that one task unites: 4 MB.
FEW = 1 << 18


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the sets of a and b; root[x] is the smallest member known of x's set."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (deeper := root[root]).tobytes() != root.tobytes():
            root[:] = deeper


def _at_once(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, np.ndarray]]:
    """All links in, each node but the smallest of its component out."""
    links = np.concatenate([np.zeros((2, 0), np.int64), *[np.array([x["a"], x["b"]], np.int64) for x in batches]], axis=1)
    nodes, at = np.unique(links, return_inverse=True)
    at = at.reshape(links.shape)
    root = np.arange(len(nodes))
    unite(root, at[0], at[1])
    own = np.flatnonzero(root != np.arange(len(root)))
    yield {"a": nodes[own], "b": nodes[root[own]]}


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour, or to itself if that is smaller."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return join_by_key(both.where("b > a"), least, "a", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    met = join_by_key(down, least, "a", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, space: Workspace, name: str = "links", few: int = FEW) -> DataFrame:
    """a, b: each node that has links, but the smallest of its component, with that smallest node.

    Links may repeat and lead from a node to itself; an empty table gives none. However many links a node has, minima
    are taken in each task first and it is joined where its links lie. `few` links or fewer are united at once.
    """
    now, state, round_ = space.save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0"), None, 0
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            return now
        if state is None and mark[0] <= few:
            return space.save(map_rows(now.coalesce(1), _at_once, "a long,b long"), f"{name}_united")
        state, round_ = mark, round_ + 1
        large = space.save(_large_star(now, mark[0]).distinct(), f"{name}_large{round_}")
        now = space.save(_small_star(large, mark[0]).distinct(), f"{name}{round_}")
        space.drop(f"{name}_large{round_}")
        space.drop(f"{name}{round_ - 1}")
