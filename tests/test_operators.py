from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from textloom.config import EngineConfig
from textloom.operators import dedup, diff, distill, levels, recall, repository, search, session
from textloom.operators.dedup import Answers
from textloom.sources import files, messages


def test_answers_in_order():
    a = Answers()
    assert [a.check(x) for x in ("A x", "A x", "B y", "A x")] == [None, "[DUPLICATE: exact match response #1]", None, "[DUPLICATE: exact match response #1]"]
    assert a.check("B y ") is None  # {B, y, ''} against {B, y} is two thirds
    assert Answers(0.6).check("x") is None
    again = Answers(0.8, a.state)
    assert again.check("A x") == "[DUPLICATE: exact match response #1]" and again.seen == a.seen + 1
    for i in range(60):
        again.check(f"word{i} " * 3)
    assert again.check("A x") is None  # fifty later ones have pushed it out


def test_jaccard(spark):
    rows = spark.createDataFrame([("a b", "b c"), (" a", "a"), ("", ""), ("x" * 50_001, "x" * 50_001)], "a string, b string")
    assert [round(r[0], 6) for r in rows.select(dedup.jaccard(F.col("a"), F.col("b"))).collect()] == [0.333333, 0.5, 1.0, 0.0]


def test_similar_pairs_against_all_pairs(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(r.sample(words, r.randint(1, 8))) for _ in range(60)]
    texts += [t + " extra" for t in texts[:20]] + texts[:5] + ["", " ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for threshold in (0.3, 0.8, 1.0):
        got = {(x.id_a, x.id_b) for x in dedup.similar_pairs(df, df, threshold).collect()}
        sets = [None if t is None else set(__import__("re").split(r"\s+", t)) for t in texts]
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a is not None and b is not None and len(a & b) / len(a | b) >= threshold}
        assert got == want
        half = [tuple(sorted((x.id_a, x.id_b))) for x in dedup.similar_pairs(df, df, threshold, once=True).collect()]
        assert len(half) == len(set(half)) and set(half) == {(i, j) for i, j in want if i < j and sets[i] != sets[j]}
    members = {x.id: x.rep_id for x in dedup.equal_sets(df).collect()}
    assert members == {i: next(j for j, b in enumerate(sets) if b == a and (a is not None or i == j)) for i, a in enumerate(sets)}


def test_replay_and_stream_agree(spark, tmp_path):
    from textloom.streaming.state import mark_duplicates, rate_limit, run_to_end, windowed_counts

    talks = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "text")
    talks = talks.unionByName(talks.withColumn("turn", F.col("turn") + 1000))
    talks.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(talks.schema).parquet(str(tmp_path / "in"))
    run_to_end(mark_duplicates(stream, "conv_id", "turn"), str(tmp_path / "out"), str(tmp_path / "state"))
    a = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("conv_id", "turn", "marker").collect()))
    b = sorted(map(tuple, dedup.replay(talks, "conv_id", "turn").select("conv_id", "turn", "marker").collect()))
    assert a == b and any(m for *_, m in a)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert rate_limit.__doc__ and set(windowed_counts(events, "ts", "event_type").columns) == {"start", "event_type", "n"}


def test_rate_window():
    w = session.RateWindow()
    assert [w.admit(i) for i in range(61)] == [200] * 60 + [429]
    assert w.admit(60_000) == 429 and w.admit(60_001) == 200


def test_pressure_and_levels(spark):
    rows = spark.createDataFrame([(n,) for n in (24_999, 25_000, 50_000, 80_000, None)], "n long")
    assert [r[0].mode for r in rows.select(session.pressure(F.col("n"))).collect()] == ["lite", "standard", "aggressive", "brutal", "lite"]
    cfg = EngineConfig()
    assert session.next_level("lite", 90_000, 30, cfg) == "brutal" and session.next_level("brutal", 0, 10, cfg) == "brutal"
    assert session.next_level("standard", 0, 10, cfg) == "aggressive" and session.next_level("standard", 0, 70, cfg) == "lite" and session.next_level("standard", 0, 40, cfg) == "standard"


def test_tracked_reads_and_diffs(spark):
    rows = spark.createDataFrame([("p", 1, ""), ("p", 2, "a\nb"), ("p", 3, "a\nb"), ("p", 4, "a\nc\nd"), ("p", 5, "a\nc\nd\n")], "path string, n int, text string")
    assert [r.seen for r in dedup.track_reads(rows, "path", "n").orderBy("n").collect()] == [None, None, "[FILE UNCHANGED]", "[DIFF-ONLY: 3 changes]\n- L2: b\n+ L2: c\n+ L3: d", "[FILE UNCHANGED]"]
    pair = spark.createDataFrame([("a\nb", "a\nb\n")], "x string, y string")
    assert diff.diff(pair, "x", "y").first()["diff"] == ["+ L3: "]
    one = spark.createDataFrame([(1, "a\nb")], "pair int, text string")
    two = spark.createDataFrame([(1, "a\nc\nd")], "pair int, text string")
    assert sorted((r.line_no, r.old, r.new) for r in diff.diff_rows(one, two).collect()) == [(2, "b", "c"), (3, None, "d")]


def test_search(spark):
    rows = spark.createDataFrame([(1, "x\nA hit\ny\nhit\nz"), (2, "none")], "doc_id long, text string")
    got = search.grep(rows, "HIT", context=1).orderBy("line_no").collect()
    assert [(r.line_no, r.block) for r in got] == [(2, "  L1: x\n> L2: A hit\n  L3: y"), (4, "  L3: y\n> L4: hit\n  L5: z")]
    three = spark.createDataFrame([("a\nb\nc",)], "t string")
    show = lambda a, b: three.select(search.line_range(F.col("t"), F.lit("f"), a, b)).first()[0]
    assert show(0, 99) == "[FILE: f | Lines 1-3 of 3 | 3 lines]\nL1: a\nL2: b\nL3: c" and show(5, 2) == "[ERROR: startLine (5) > endLine (2)]" and show(2, None).endswith("\nL2: b")
    parts = search.chunked_text(spark.createDataFrame([(1, "abcdefghij"), (2, "")], "doc_id long, text string"), size=1).orderBy("chunk_no").collect()
    assert [p.chunk for p in parts] == ["abcd", "efgh", "ij"] and parts[0].shown == "\n--- CHUNK 1/3 ---\nabcd\n"


def test_distil_equals_the_one_pass(spark):
    from textloom.functions.onepass import distil

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.distilled for r in distill.distil(docs).collect()}
    for r in docs.collect():
        assert distil(r.text, 0.3) == got.get(r.doc_id, r.text)
    long = spark.createDataFrame([("A b. " * 500,), ("short. text",)], "text string")
    assert distill.distil(spark.createDataFrame([(1, None), (2, ""), (3, "a. " * 4)], "doc_id long, text string")).count() == 0
    assert [len(r.summary) for r in distill.first_sentences(long).collect()] == [pytest.approx(749, abs=160), 11]


def test_recall(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in recall.top_k(rows, [1.0, 0.0], 4).collect()] == [1, 4, 3, 2]
    near = recall.nearest(rows, rows.where("vec_id < 4"), 2).collect()
    assert sorted((r.query_id, r.place, r.vec_id) for r in near) == [(1, 1, 1), (1, 2, 4), (2, 1, 1), (2, 2, 2), (3, 1, 3), (3, 2, 1)]


def test_repository(spark):
    names = [("a/block.py", 10), ("b.png", 200_000), ("x.lock", 8), (".git/x", 5), ("node_modules/q.js", 7), ("package-lock.json", 40), ("obj/z.txt", 1)]
    rows = spark.createDataFrame(names, "path string, size long")
    a = repository.audit(rows).first()
    assert (a.n_files, a.n_binary, a.n_generated, a.n_large) == (7, 1, 3, 1) and a.total_tokens == 50_018
    assert {r.path for r in repository.removable(rows).collect()} == {"b.png", "node_modules/q.js", "package-lock.json", "obj/z.txt"}
    assert {r.kind for r in repository.project_kinds(rows).collect()} == {"python"}
    assert [r.path for r in repository.matching(rows, "**/*.P?").collect()] == ["a/block.py"]
    assert {r.line for r in repository.tree(rows, 1).collect()} >= {"  📁 a/", "  📄 b.png (195.3KB, ~50000 tok)"}
    assert repository.audit(rows.limit(0)).first().waste_pct == 0.0


def test_levels(spark):
    rows = spark.createDataFrame([(1, "Please see the number 5 at http://x.y/z and the configuration of the application in order to act."), (2, "")], "doc_id long, text string")
    got = levels.benchmark(rows).collect()
    assert len(got) == 5 and sum(r.is_best for r in got) == 1 == sum(r.is_recommended for r in got)
    s = {r.doc_id: r for r in levels.summarise(rows, 5).collect()}
    assert s[2].used_mode == "raw" and s[1].used_mode == "oblivion" and s[1].summary.endswith("[TRUNCATED: exceeded 5 token budget]")


def test_messages_and_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "yarn.lock").write_text('{"a": "1",\n"b": "2"}')
    (tmp_path / "big.txt").write_text("x" * 30_001)
    got = {r.path.rsplit("/", 1)[1]: r.n for r in files.texts(spark, f"file://{tmp_path}").select("path", files.notice(F.col("text"), F.col("path")).alias("n")).collect()}
    assert got["yarn.lock"].startswith("[SKIPPED: yarn.lock — auto-generated (20 chars, 2 lines). Dependencies: 2") and got["big.txt"].startswith("[FILE TOO LARGE")
    assert files.listing(spark, f"file://{tmp_path}").count() == 2
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["the application " * 20, "the application " * 20, '{"a": ' + "1" * 300 + "}", "short", None])], "s int, n int, text string")
    out = {r.n: r for r in messages.reduce_results(rows, "s", "n").collect()}
    assert out[1].text == "[DUPLICATE: exact match response #1]" and out[3].text == "short" and out[4].text is None and out[0].tokens_saved > 0
    lines = spark.createDataFrame([('{"id":"1","method":"tools/call","params":{"name":"t","arguments":{"q":"' + "the application " * 20 + '","k":"v"}}}',), ("{bad",)], "value string")
    args = {r.key: r for r in messages.compress_arguments(messages.parse(lines).where("message.id is not null")).collect()}
    assert args["k"].text == "v" and args["q"].tokens_saved > 0
