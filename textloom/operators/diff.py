"""Line-by-line comparison by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import lines


def line_changes(a: Column, b: Column, *, missing_is_empty: bool = True) -> Column:
    """Array of `- L{n}: old` and `+ L{n}: new` for the places where two texts' lines differ."""
    pairs = F.zip_with(lines(a), lines(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def shown(p: Column, i: Column) -> Column:
        x, y = p["x"], p["y"]
        differ = (F.coalesce(x, F.lit("")) != F.coalesce(y, F.lit(""))) if missing_is_empty else ~x.eqNullSafe(y)
        at = (i + 1).cast("string")
        return F.when(differ, F.array_compact(F.array(F.concat(F.lit("- L"), at, F.lit(": "), x), F.concat(F.lit("+ L"), at, F.lit(": "), y)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(pairs, shown))


def diff(df: DataFrame, a: str, b: str, out: str = "diff") -> DataFrame:
    """df with an array of changed lines between two text columns; a missing line differs from an empty one."""
    return df.withColumn(out, line_changes(F.col(a), F.col(b), missing_is_empty=False))


def diff_rows(left: DataFrame, right: DataFrame, *, text_col: str = "text") -> DataFrame:
    """pair, line_no, old, new: for texts too long for an array expression, as a join of lines by place."""
    rows = lambda df, name: df.select("pair", F.posexplode(lines(F.col(text_col))).alias("line_no", name)).withColumn("line_no", F.col("line_no") + 1)
    return rows(left, "old").join(rows(right, "new"), ["pair", "line_no"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
