"""JSON shredding over a table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import ship


def shred(df: DataFrame, *, text_col: str = "text", out: str = "shredded") -> DataFrame:
    """df with the shorter form of its JSON texts, and the maps of keys and values that give the original names."""
    ship(df.sparkSession)

    @F.pandas_udf("text string, key_map map<string,string>, value_map map<string,string>")
    def shredded(s: pd.Series) -> pd.DataFrame:
        from textloom.functions.json_shred import shred

        return pd.DataFrame([shred(x) for x in s], columns=["text", "key_map", "value_map"])

    done = df.withColumn("made_", shredded(text_col))
    return done.withColumns({out: F.col("made_.text"), "key_map": F.col("made_.key_map"), "value_map": F.col("made_.value_map")}).drop("made_")


def leaf_counts(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """id, value, n: long strings that occur twice or more in a text, counted as rows."""
    strings = F.regexp_extract_all(F.col(text_col), F.lit(r':\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return df.select(id_col, F.explode(strings).alias("value")).where(F.length("value") >= 10).groupBy(id_col, "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
