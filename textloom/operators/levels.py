"""Comparing the levels: a benchmark of all five, and the mildest that fits a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.config import MODES, EngineConfig
from textloom.functions.text import BEGIN, END, SPACE, estimate_tokens, length16, quarter_tokens
from textloom.operators.compress import at_all_levels

#: What a level should keep, and how it is counted.
KEPT = (("urls", f"(?i)https?://[^{SPACE[1:-1]}]+"), ("numbers", f"{BEGIN}[0-9]+{END}"), ("inline_code", "`[^`]+`"))
ORDER = {m: i for i, m in enumerate(MODES)}


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def benchmark(df: DataFrame, cfg: EngineConfig | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text and level: lengths, naive tokens, shares saved, words, mean word length, vowels in per cent,
    whether URLs, numbers or inline code went, and whether the level is the best or the recommended one.

    Ties go to the milder level. Texts without characters have no shares and are left out.
    """
    rows = at_all_levels(df.where(F.length(text_col) > 0).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), cfg)
    text, out = F.col("text"), F.col("compressed")
    n, m = length16(text), length16(out)
    words = _count(out, f"[^{SPACE[1:-1]}]+")
    letters = m - _count(out, SPACE)
    lost = [((_count(text, p) > 0) & (_count(text, p) != _count(out, p))).alias(f"lost_{k}") for k, p in KEPT]
    share = lambda a, b: F.round((a - b) / a * 100, 1)
    rows = rows.select(
        "doc_id", "mode", n.cast("long").alias("chars_before"), m.cast("long").alias("chars_after"), quarter_tokens(text).alias("tokens_before"), quarter_tokens(out).alias("tokens_after"),
        share(n, m).alias("chars_saved_pct"), share(quarter_tokens(text), quarter_tokens(out)).alias("tokens_saved_pct"), words.cast("long").alias("n_words"),
        F.round(F.when(words > 0, letters / words).otherwise(0.0), 1).alias("mean_word"), F.round(_count(out, "[aeiouAEIOU]") / F.greatest(m, F.lit(1)) * 100, 1).alias("vowels_pct"), *lost,
    )
    lossless = ~(F.col("lost_urls") | F.col("lost_numbers") | F.col("lost_inline_code"))
    saves = F.col("chars_saved_pct") > 0
    rank = F.create_map(*[F.lit(x) for p in ORDER.items() for x in p])[F.col("mode")]
    kind = F.when(lossless & saves & (F.col("vowels_pct") > 4), 0).when(lossless & saves, 1).when(F.col("mode") == "aggressive", 2).otherwise(3)
    own = Window.partitionBy("doc_id")
    best = F.row_number().over(own.orderBy(F.desc("chars_saved_pct"), "rank")) == 1
    recommended = F.row_number().over(own.orderBy("kind", F.desc("chars_saved_pct"), "rank")) == 1
    return rows.withColumns({"rank": rank, "kind": kind}).withColumns({"is_best": best, "is_recommended": recommended}).drop("rank", "kind")


def summarise(df: DataFrame, budget: int = 500, cfg: EngineConfig | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, used_mode, used_tokens, summary: the text itself if it fits, else the mildest level that does, else the
    strongest one cut to the budget, with a note."""
    fits = lambda c: estimate_tokens(c) <= budget
    text = df.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    small = text.where(fits(F.col("text"))).select("doc_id", F.lit("raw").alias("used_mode"), estimate_tokens(F.col("text")).alias("used_tokens"), F.col("text").alias("summary"))
    tried = at_all_levels(text.where(~fits(F.col("text"))), cfg)
    rank = F.create_map(*[F.lit(x) for p in ORDER.items() for x in p])[F.col("mode")]
    own = F.struct(F.when(fits(F.col("compressed")), rank).otherwise(len(MODES) + len(MODES) - rank).alias("rank"), F.col("mode").alias("used_mode"), F.col("compressed").alias("out"))
    chosen = tried.groupBy("doc_id").agg(F.min(own).alias("x")).select("doc_id", "x.*")
    cut = F.concat(F.substring("out", 1, int(budget * 3.5)), F.lit(f"\n\n[TRUNCATED: exceeded {budget} token budget]"))
    chosen = chosen.withColumn("summary", F.when(F.col("rank") < len(MODES), F.col("out")).otherwise(cut))
    return small.unionByName(chosen.select("doc_id", "used_mode", estimate_tokens(F.col("summary")).alias("used_tokens"), "summary"))
