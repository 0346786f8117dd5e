"""Every registered query with SQL against DuckDB, at the smallest scale."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textloom.operators import dedup

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_against_sql(spark, name):
    frame = entry.queries()[name](spark, SF)
    names = sorted(frame.columns)
    got = sorted((tuple(rounded(r[c]) for c in names) for r in frame.collect()), key=repr)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    want = sorted((tuple(rounded(row[columns.index(c)]) for c in names) for row in result.fetchall()), key=repr)
    assert got == want


def collected(spark, name):
    return entry.queries()[name](spark, SF).collect()


def plain_marks(rows, threshold=0.8):
    """Each session's texts against its last 50 answers that were no duplicates, by plain loops."""
    out, held, seen, now = {}, [], 0, None
    for key, n, text in sorted(rows):
        if key != now:
            now, held, seen = key, [], 0
        seen += 1
        own, mark = set(re.split(r"\s+", text)), None
        exact = [i for i, t in held if t == text]
        if exact:
            mark = f"[DUPLICATE: exact match response #{exact[0]}]"
        else:
            for i, t in held:
                other = set(re.split(r"\s+", t))
                if (alike := len(own & other) / len(own | other)) >= threshold:
                    mark = f"[DUPLICATE: ~{int(alike * 100 + 0.5)}% similar to response #{i}]"
                    break
        if mark is None:
            held = [*held, (seen, text)][-50:]
        out[key, n] = mark
    return out


def test_duplicate_marks_against_plain_loops(spark):
    turns = [(r.conv_id, r.turn, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    want = plain_marks(turns)
    again = [(k, n + 1000, t if n % 2 else t.replace(" ", " x ", 1)) for k, n, t in turns]  # the tables hold no repeats
    marked = {(r.conv_id, r.turn): r.marker for r in dedup.replay(spark.createDataFrame(turns + again, "conv_id long, turn long, text string"), "conv_id", "turn").collect()}
    assert marked == plain_marks(turns + again) and sum(m is not None for m in marked.values()) > 20
    for name in ("dedup_replay", "stream_dedup"):
        got = collected(spark, name)
        assert len(got) == len(turns) and {(r.conv_id, r.turn): r.marker for r in got} == want, name


def test_function_bodies_of_texts_without_braces(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.body for r in collected(spark, "function_body")}
    assert got.keys() == texts.keys()
    plain = {i: t for i, t in texts.items() if not re.search(r"[{}'\"`/]", t)}
    assert len(plain) > 20
    for i, t in plain.items():
        lines = ["const f = (x) => {", *t.split("\n"), "}"]
        assert got[i] == f"[SNIPER: a.js \u2192 f | {len(lines)} lines]\n" + "\n".join(lines)


def test_whole_tables_are_compressed(spark):
    """Every row comes back once, texts too short to compress as they are, and the one-pass form agrees on each."""
    from textloom.config import EngineConfig
    from textloom.functions import onepass
    from textloom.functions.languages import language_pass
    from textloom.operators.compress import before

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.compressed for r in collected(spark, "compress_documents")}
    assert got.keys() == texts.keys() and all(got[i] == t for i, t in texts.items() if len(t) < 50)
    cfg = EngineConfig()
    ready = {r.doc_id: r.x for r in docs.select("doc_id", before(F.col("text"), cfg).alias("x")).collect()}
    long = [(i, onepass.compress(ready[i], t, cfg.mode, cfg, None)) for i, t in texts.items() if len(t) >= 50]
    done = spark.createDataFrame(long, "doc_id long, x string").select("doc_id", language_pass(F.col("x"), cfg).alias("x"))
    assert {r.doc_id: r.x for r in done.collect()} == {i: got[i] for i, _ in long}
    assert sum(map(len, got.values())) < sum(map(len, texts.values()))


@pytest.mark.parametrize(("name", "source", "key"), [("reduce_pages", "pages", "page_id"), ("adaptive_levels", "documents", "doc_id"), ("proxy_results", "conversations", "turn")])
def test_query_without_sql_returns_each_row_once(spark, name, source, key):
    rows = spark.read.parquet(f"{SF}/{source}.parquet").collect()
    got = collected(spark, name)
    assert sorted(r[key] for r in got) == sorted(r[key] for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
