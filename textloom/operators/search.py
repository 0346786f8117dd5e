"""Lines: search with context, ranges, chunks, and functions by name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import length16, lines
from textloom.runtime import ship

#: Limits of a search; None takes one away.
MAX_FILES, MAX_MATCHES, MAX_LENGTH = 500, 200, 500 * 1024


def grep(df: DataFrame, pattern: str, *, context: int = 2, id_col: str = "doc_id", text_col: str = "text", max_matches: int | None = MAX_MATCHES, max_length: int | None = MAX_LENGTH) -> DataFrame:
    """doc_id, line_no, block: lines that hold a string, whatever its case, with lines around them.

    Texts without the string are passed over before they are cut into lines. Each hit has its own block, in order of
    doc_id and line; only the first `max_matches` are shown.
    """
    text = F.col(text_col)
    hits = df.where(F.lower(text).contains(pattern.lower()))
    if max_length is not None:
        hits = hits.where(length16(text) <= max_length)
    of = hits.select(F.col(id_col).alias("doc_id"), lines(text).alias("of"))
    at = F.filter(F.sequence(F.lit(0), F.size("of") - 1), lambda i: F.lower(F.get("of", i)).contains(pattern.lower()))
    found = of.select("doc_id", "of", F.explode(at).alias("i"))
    around = F.sequence(F.greatest(F.col("i") - context, F.lit(0)), F.least(F.col("i") + context, F.size("of") - 1))
    shown = F.transform(around, lambda j: F.concat(F.when(j == F.col("i"), "> L").otherwise("  L"), (j + 1).cast("string"), F.lit(": "), F.get("of", j)))
    out = found.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), F.array_join(shown, "\n").alias("block"))
    return out if max_matches is None else out.orderBy("doc_id", "line_no").limit(max_matches)


def line_range(c: Column, name: Column, start: int, end: int | None = None) -> Column:
    """A header and the numbered lines from start to end, both cut to what there is."""
    of = lines(c)
    a, b = F.lit(max(1, start)), F.least(F.size(of), F.lit(end or start))
    part = F.transform(F.slice(of, a, F.greatest(b - a + 1, F.lit(0))), lambda x, i: F.concat(F.lit("L"), (i + a).cast("string"), F.lit(": "), x))
    head = F.concat(F.lit("[FILE: "), name, F.lit(" | Lines "), a.cast("string"), F.lit("-"), b.cast("string"), F.lit(" of "), F.size(of).cast("string"), F.lit(" | "), (b - a + 1).cast("string"), F.lit(" lines]\n"))
    error = F.concat(F.lit("[ERROR: startLine ("), a.cast("string"), F.lit(") > endLine ("), b.cast("string"), F.lit(")]"))
    return F.when(a > b, error).otherwise(F.concat(head, F.array_join(part, "\n")))


def chunks(df: DataFrame, *, size: int = 4000, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each chunk of size x 4 characters: keep columns, chunk_no, n_chunks, chunk. Empty texts have none."""
    step = size * 4
    n = F.ceil(F.length(text_col) / step).cast("int")
    at = F.explode(F.sequence(F.lit(1), F.col("n_chunks")))
    rows = df.withColumn("n_chunks", n).where("n_chunks > 0").select(*keep, text_col, "n_chunks", at.alias("chunk_no"))
    return rows.select(*keep, F.col("chunk_no").cast("long"), F.col("n_chunks").cast("long"), F.substring(F.col(text_col), (F.col("chunk_no") - 1) * step + 1, F.lit(step)).alias("chunk"))


def chunked_text(df: DataFrame, *, size: int = 4000, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Chunks with their headings."""
    head = F.concat(F.lit("\n--- CHUNK "), F.col("chunk_no").cast("string"), F.lit("/"), F.col("n_chunks").cast("string"), F.lit(" ---\n"), F.col("chunk"), F.lit("\n"))
    return chunks(df, size=size, text_col=text_col, keep=keep).withColumn("shown", head)


def function_bodies(df: DataFrame, *, code_col: str, name_col: str, function_col: str, out: str = "body") -> DataFrame:
    """df with the named function's or class's lines, braces counted outside quotes and comments."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def body(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from textloom.functions.onepass import function_body

        for code, name, function in it:
            yield pd.Series([function_body(*x) for x in zip(code, name, function, strict=True)], dtype=object)

    return df.withColumn(out, body(code_col, name_col, function_col))


