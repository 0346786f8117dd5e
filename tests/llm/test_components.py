from __future__ import annotations

import random

import pytest

from textloom.llm.common import Workspace
from textloom.llm.components import components


def brute(links):
    root = {x: x for l in links for x in l}
    while True:
        nxt = dict(root)
        for a, b in links:
            nxt[a] = nxt[b] = min(nxt[a], nxt[b])
        if nxt == root:
            return sorted((x, y) for x, y in root.items() if x != y)
        root = nxt


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_links_united_at_once_or_in_rounds(spark, few):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(40, 60)] + [(-7, 5), (5, 5), (1 << 62, -(1 << 63))] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)]
    r.shuffle(links)
    space = Workspace(spark, "components")
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    assert sorted(tuple(x) for x in components(df, space, few=few).collect()) == brute(links)
    assert components(df.limit(0), space, "none", few=few).count() == 0


def test_a_small_table_is_united_in_few_queries(spark):
    """Planning is what the driver's memory is spent on: a small table has no rounds."""
    space = Workspace(spark, "components")
    df = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    saved, save = [], space.save
    space.save = lambda table, name: saved.append(name) or save(table, name)
    assert components(df, space).count() == 30
    assert len(saved) <= 2


def test_the_drivers_jvm_gives_native_memory_back(spark):
    from textloom import workspace

    assert workspace.give_back(spark)
    spark.sparkContext._jvm.java.lang.System.gc()  # the session goes on
    assert spark.range(3).count() == 3
