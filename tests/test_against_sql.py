"""Queries against their SQL on rows that the tables hold seldom: halves, empty and null texts."""

from __future__ import annotations

import duckdb

import __spark_entry__ as entry


def both(spark, folder, name, rows):
    """Sorted rows of the query and of its SQL over a table of (doc_id, text, source, n_chars)."""
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    frame = entry.queries()[name](spark, str(folder))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(frame.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(repr, map(tuple, frame.collect()))), sorted(map(repr, want))


def test_tree_rounds_halves_as_sql(spark, tmp_path):
    sizes = [*range(100, 120), *[1024 * k + part for k in range(12) for part in (0, 256, 512, 768)]]  # 9/1024 of them are shown
    got, want = both(spark, tmp_path, "repo_tree", [(i * 5, "x", "s", n) for i, n in enumerate(sizes)])
    assert got == want and any("(2.2KB" in x for x in want)


def test_batch_shares_as_sql(spark, tmp_path):
    texts = ["x" * m + " " * (n - m) for n, m in ((2000, 721), (2000, 723), (2000, 901), (8, 7), (16, 9), (400, 397), (80, 1))]
    got, want = both(spark, tmp_path, "batch_stats", [(i, t, "s", 1) for i, t in enumerate([*texts, "", None, "the end"])])
    assert got == want and sum("nan" in x for x in want) == 1
