"""Extractive summaries: the sentences with the highest tf-idf sums. A sentence's words are weighed against its own
document alone, so every document is summarised where it lies and nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import onepass
from textloom.functions.text import length16
from textloom.runtime import ship


def distil(df: DataFrame, ratio: float = 0.3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_kept, distilled: the best share of the sentences (ties: the earlier one), in their order.

    Null texts and those with too few sentences give no row; rows that repeat give one each.
    """
    ship(df.sparkSession)
    own = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [onepass.best_sentences(t, ratio) for t in batch.column("text").to_pylist()]
            rows = [i for i, x in enumerate(best) if x is not None]
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(best[i]) for i in rows], pa.int64()), pa.array([" ".join(best[i]) for i in rows], pa.string())], ["doc_id", "n_kept", "distilled"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_kept long, distilled string")


def first_sentences(df: DataFrame, ratio: float = 0.3, *, least: int = 2000, text_col: str = "text", out: str = "summary") -> DataFrame:
    """df with the first share of a long text's sentences; a shorter text as it is."""
    own = F.regexp_extract_all(F.col(text_col), F.lit(r"([^.!?]+[.!?]+)"), F.lit(1))
    own = F.when(F.size(own) > 0, own).otherwise(F.array(F.col(text_col)))
    return df.withColumn(out, F.when(length16(F.col(text_col)) > least, F.array_join(F.slice(own, F.lit(1), F.greatest(F.lit(1), F.ceil(F.size(own) * ratio).cast("int"))), " ")).otherwise(F.col(text_col)))
