"""Files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.reduce import generated_notice, is_generated_file
from textloom.functions.text import length16, round_binary
from textloom.operators.repository import base_name, glob_pattern

#: Longer files are refused.
LARGE = 30_000


def texts(spark: SparkSession, path: str, *, glob: str | None = None) -> DataFrame:
    """path, text: whole files as UTF-8, any depth below path; broken bytes become U+FFFD."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = read.load(path).where(base_name(F.col("path")).rlike(glob_pattern(glob)))
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, size below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"))


def notice(text: Column, path: Column) -> Column:
    """What is shown in place of a generated or a large file; null for others."""
    large = F.concat(F.lit("[FILE TOO LARGE: "), path, F.lit(" is "), length16(text).cast("string"), F.lit(" chars. Use read_file_range, grep_files, or functionName param instead.]"))
    name = base_name(path)
    return F.when(is_generated_file(name), generated_notice(text, name)).when(length16(text) > LARGE, large)


def batch_report(df: DataFrame, *, name_col: str, text_col: str = "text", compressed: str = "compressed") -> DataFrame:
    """name, chars_before, chars_after, saved_pct of a compressed batch; the share of an empty text is NaN (0 of 0)."""
    n, m = length16(F.col(text_col)), length16(F.col(compressed))
    share = F.when(n > 0, round_binary((n - m) / n * 100, 1)).when(n == 0, float("nan"))
    return df.select(F.col(name_col).alias("name"), n.cast("long").alias("chars_before"), m.cast("long").alias("chars_after"), share.alias("saved_pct"))
