from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from textloom.config import EngineConfig
from textloom.functions import reduce
from textloom.operators import cache, recall, session


def plain_hits(keys, capacity):
    """By a list of keys, the last used at its end."""
    held, hits = [], []
    for k in keys:
        hits.append(k in held)
        held = [x for x in held if x != k] + [k]
        held = held[-capacity:]
    return hits, held[::-1]


@pytest.mark.parametrize("capacity", [1, 3, 100])
def test_replay_and_held_against_a_list(spark, capacity):
    r = random.Random(capacity)
    rows = [(s, i, r.choice(["a", "b", "c", "d", "", None])) for s in ("x", "y", None) for i in range(40)]
    df = spark.createDataFrame(rows, "session string, at long, key string")
    got = {(x.session, x.at): x.hit for x in cache.replay(df, "session", "at", "key", capacity=capacity).collect()}
    held = cache.held(df, "session", "at", "key", capacity=capacity).collect()
    for s in ("x", "y", None):
        hits, last = plain_hits([k for own, _, k in rows if own == s], capacity)
        assert [got[s, i] for i in range(40)] == hits
        assert [x.key for x in sorted((x for x in held if x.session == s), key=lambda x: x.place)] == last
    assert cache.replay(df.limit(0), "session", "at", "key").count() == cache.held(df.limit(0), "session", "at", "key").count() == 0


def test_a_large_cache_keeps_its_newer_half(spark, tmp_path):
    df = spark.createDataFrame([("s", i, f"k{i}", "v" * 100) for i in range(5)], "session string, at long, key string, value string")
    small = cache.held(df, "session", "at", "key", value="value", most_bytes=300)
    assert sorted(x.key for x in small.collect()) == ["k3", "k4"]
    cache.store(cache.held(df, "session", "at", "key", value="value"), str(tmp_path / "c"))
    assert {x.key: x.value for x in cache.load(spark, str(tmp_path / "c")).collect()} == {f"k{i}": "v" * 100 for i in range(5)}


def test_keys_tell_settings_apart(spark):
    df = spark.createDataFrame([("t", "a.txt"), ("t", "b.txt"), (None, "a.txt")], "text string, name string")
    key = lambda cfg: [x[0] for x in df.select(cache.result_key(F.col("text"), F.col("name"), cfg)).collect()]
    many = key(EngineConfig()) + key(EngineConfig(mode="lite")) + key(EngineConfig(abbreviations={"x": "y"}))
    assert len(set(many)) == 9 and key(EngineConfig()) == many[:3]


def test_readings_of_files(spark):
    big = "word " * 7000
    steps = [("a", "one\ntwo", "compressed", "one\ntwo"), ("a", "one\nthree", "changed", "[DIFF-ONLY: 2 changes]\n- L2: two\n+ L2: three"), ("a", "one\ntwo", "cached", "one\ntwo"),
             ("a", "one\nthree", "unchanged", "[FILE UNCHANGED]"), ("a", big, "notice", f"[FILE TOO LARGE: a is {len(big)} chars. Use read_file_range, grep_files, or functionName param instead.]"),
             ("a", None, "changed", "[DIFF-ONLY: 3 changes]\n- L1: one\n+ L1: \n- L2: three"), ("a", "new", "compressed", "new"), ("a", "new", "cached", "new"), ("b", "", "compressed", ""), ("b", "x", "compressed", "x")]
    df = spark.createDataFrame([(p, i, t) for i, (p, t, *_) in enumerate(steps)], "path string, at long, text string")
    got = {x.at: (x.kind, x.shown) for x in cache.read_files(df, "path", "at").collect()}
    assert [got[i] for i in range(len(steps))] == [(k, s) for _, _, k, s in steps]
    assert cache.read_files(df.limit(0), "path", "at").count() == 0


def test_answers_meet_their_requests(spark):
    rows = [("u", "1", 1, True), ("u", "1", 2, True), ("u", "1", 3, False), ("u", "1", 4, False), ("u", "2", 5, False), ("v", "1", 6, False)]
    df = spark.createDataFrame(rows, "upstream string, id string, at long, request boolean")
    assert {x.at: x.asked for x in cache.answers(df, "upstream", "id", "at", is_request=F.col("request")).collect()} == {3: 2, 4: None, 5: None, 6: None}


def test_screened_requests(spark):
    long = session.LONGEST_REQUEST
    rows = [(1, "k", 0, "x"), (2, "bad", 0, "x"), (3, "k", 1, ""), (4, "k", 2, None), (5, "k", 3, "x"), (6, None, 3, "x"), (7, "m", 0, "y" * (long + 1)), (8, "m", 0, "y" * long)]
    df = spark.createDataFrame([(i, k, datetime(2024, 1, 1, 0, 0, s), t) for i, k, s, t in rows], "event_id long, k string, at timestamp, text string")
    got = {x.event_id: x.status for x in session.screen(df, "k", "at", F.col("k") != "bad", limit=3).collect()}
    assert got == {1: 200, 2: 401, 3: 400, 4: 400, 5: 429, 6: 401, 7: 413, 8: 200}


def test_code_whitespace(spark):
    texts = ["a\n```py\n  x\n\n    y\n```\n  b\n```\n\n```", "```js\n\tx\n```", "```\nopen", "```a b\n  x\n```", "", None, "\n  plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [x[1] for x in sorted(df.select("i", reduce.strip_code_whitespace(F.col("t"))).collect())]
    assert got == ["a\n```py\nx\n  y\n```\n  b\n```\n\n```", "```js\nx\n```", "```\nopen", "```a b\n  x\n```", "", None, "\n  plain"]


def test_memory_keeps_the_last(spark):
    df = spark.range(400).withColumnRenamed("id", "at")
    assert sorted(x.at for x in recall.remembered(df, "at").collect()) == list(range(100, 400))
    one = spark.createDataFrame([("text.",), ("",), (None,)], "text string")
    got = recall.output_summaries(one, F.lit(datetime(2024, 1, 2, 3, 4, 5)), F.lit("s")).select("stored_text", "original_length", "summary_length").collect()
    assert [tuple(x) for x in got] == [("[OUTPUT_SUMMARY 2024-01-02T03:04:05.000Z] s", 5, 1), (None, 0, 0), (None, 0, 0)]
