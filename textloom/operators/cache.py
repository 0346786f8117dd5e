"""Result caches as tables: keys, which requests of a replay hit, what is held at the end, the order of a file's
readings, and answers matched to requests.

A null key is a key like any other. Rows of a session that tie in order are taken by key.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.config import EngineConfig
from textloom.operators.compress import compress
from textloom.operators.diff import line_changes
from textloom.runtime import ship
from textloom.sources.files import notice

#: Results that a session's cache holds, and bytes that a stored cache may have.
CAPACITY, MOST_BYTES = 100, 10 * 1024 * 1024


def result_key(text: Column, context: Column, cfg: EngineConfig | None = None) -> Column:
    """A compressed text's key: its digest, what it was read as, and the settings that shape the result, so that another
    level never answers."""
    cfg = cfg or EngineConfig()
    settings = [cfg.mode, cfg.redact_pii, cfg.skeleton, cfg.distill, cfg.distill_ratio, cfg.strict_protect]
    more = [sorted(x.items()) for x in (cfg.abbreviations, cfg.brutal_replacements, cfg.indonesian or {})]
    parts = F.struct(F.sha2(F.coalesce(text, F.lit("")), 256).alias("h"), context.alias("ctx"), F.lit(repr((settings, more))).alias("cfg"))
    return F.sha2(F.to_json(parts), 256)


class Recent:
    """The keys used last, at most `capacity`."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.held = capacity, OrderedDict()

    def use(self, key: object) -> bool:
        """Whether key is held; it is the last one used from now on, and the one unused for longest gives way."""
        if key in self.held:
            self.held.move_to_end(key)
            return True
        if len(self.held) >= self.capacity:
            self.held.popitem(last=False)
        self.held[key] = None
        return False


def replay(df: DataFrame, session: str, order: str, key: str, *, capacity: int = CAPACITY) -> DataFrame:
    """session, order, hit: each session's requests in order against a cache that drops what was unused for longest.

    A fold that streams through its task; memory holds `capacity` keys, never the session. Texts don't travel: give the
    key alone.
    """
    ship(df.sparkSession)
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cache = object(), Recent(capacity)
        for pdf in batches:
            hits = []
            for own, k in zip(pdf["session"], pdf["key"], strict=True):
                if own != now:
                    now, cache = own, Recent(capacity)
                hits.append(cache.use(k))
            yield pd.DataFrame({session: pdf["session"], order: pdf["at"], "hit": hits})

    rows = df.select(F.col(session).alias("session"), F.col(order).alias("at"), F.col(key).cast("string").alias("key"))
    return rows.repartition("session").sortWithinPartitions("session", "at", "key").mapInPandas(run, f"{session} {kinds[session]}, {order} {kinds[order]}, hit boolean")


def held(df: DataFrame, session: str, order: str, key: str, *, value: str | None = None, capacity: int = CAPACITY, most_bytes: int = MOST_BYTES) -> DataFrame:
    """session, key, last_used (and value as of the last use), place: what each session's cache holds at the end, the
    last used first; of one whose keys and values take more than most_bytes, the newer half.

    The keys used last are what such a cache holds whatever came before, so this is an aggregate, not a fold.
    """
    payload = F.struct(F.col(order).alias("at"), (F.col(value) if value else F.lit("")).cast("string").alias("value"))
    uses = df.groupBy(F.col(session).alias("session"), F.col(key).cast("string").alias("key")).agg(F.max(payload).alias("use"))
    by = Window.partitionBy("session")
    top = uses.withColumn("place", F.row_number().over(by.orderBy(F.desc("use.at"), F.desc("key")))).where(F.col("place") <= capacity)
    size = F.sum(F.octet_length(F.coalesce("key", F.lit(""))) + F.octet_length(F.coalesce("use.value", F.lit("")))).over(by)
    kept = top.withColumns({"size": size, "n": F.count(F.lit(1)).over(by)}).where((F.col("size") <= most_bytes) | (F.col("place") <= F.floor(F.col("n") / 2)))
    names = [F.col("session").alias(session), F.col("key").alias(key), F.col("use.at").alias("last_used"), *([F.col("use.value").alias(value)] if value else [])]
    return kept.select(*names, F.col("place").cast("long").alias("place"))


def store(entries: DataFrame, path: str) -> None:
    """What held() gives, as a table in place of the one at path."""
    entries.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_files(df: DataFrame, path: str, order: str, *, text_col: str = "text", mode: str = "aggressive", cfg: EngineConfig | None = None, capacity: int = CAPACITY) -> DataFrame:
    """path, order, kind, shown: what each reading of a file shows.

    kind is `notice` (generated or too large; not remembered), `cached` (compressed before: the same result), `changed`
    and `unchanged` (against the last reading that was neither a notice nor cached), or `compressed`. An earlier empty
    text counts as none, and a null text is empty. Results held for a file are the last `capacity` used. The fold carries
    one text a file; results are computed by expressions where they are shown.
    """
    ship(df.sparkSession)
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cache, last = object(), OrderedDict(), ""
        for pdf in batches:
            out = []
            for own, text, said in zip(pdf["path"], pdf["text"], pdf["notice"], strict=True):
                if own != now:
                    now, cache, last = own, OrderedDict(), ""
                if isinstance(said, str):
                    out.append(("notice", None))
                    continue
                digest = hashlib.sha256(text.encode()).digest()
                if digest in cache:
                    cache.move_to_end(digest)
                    out.append(("cached", None))
                    continue
                if last:
                    out.append(("unchanged", None) if text == last else ("changed", last))
                else:
                    out.append(("compressed", None))
                    if text:  # an empty result is never taken for an answer
                        if len(cache) >= capacity:
                            cache.popitem(last=False)
                        cache[digest] = None
                last = text
            yield pdf.assign(kind=[k for k, _ in out], before=pd.Series([b for _, b in out], dtype=object, index=pdf.index))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(path).alias("path"), F.col(order).alias("at"), text.alias("text"), notice(text, F.col(path).cast("string")).alias("notice"))
    schema = f"path {kinds[path]}, at {kinds[order]}, text string, notice string, kind string, before string"
    told = rows.repartition("path").sortWithinPartitions("path", "at", "text").mapInPandas(run, schema)
    todo = F.when(F.col("kind").isin("cached", "compressed"), F.col("text"))
    done = compress(told.withColumn("todo", todo), mode, cfg, text_col="todo")
    changes = line_changes(F.col("before"), F.col("text"))
    differ = F.when(F.size(changes) > 0, F.concat(F.lit("[DIFF-ONLY: "), F.size(changes).cast("string"), F.lit(" changes]\n"), F.array_join(changes, "\n"))).otherwise("[FILE UNCHANGED]")
    shown = F.when(F.col("kind") == "notice", F.col("notice")).when(F.col("kind") == "unchanged", "[FILE UNCHANGED]").when(F.col("kind") == "changed", differ).otherwise(F.col("compressed"))
    return done.select(F.col("path").alias(path), F.col("at").alias(order), "kind", shown.alias("shown"))


def answers(df: DataFrame, upstream: str, id_col: str, order: str, *, is_request: Column) -> DataFrame:
    """upstream, id, order, asked: each answer with the order of the request it answers: the last with its id, unless an
    answer came in between; null if there is none."""
    rows = df.select(F.col(upstream).alias("upstream"), F.col(id_col).alias("id"), F.col(order).alias("at"), F.coalesce(is_request, F.lit(False)).alias("request"))
    by = Window.partitionBy("upstream", "id").orderBy("at")
    before = rows.withColumns({"asked": F.lag("at").over(by), "by_request": F.lag("request").over(by)})
    asked = F.when(F.col("by_request"), F.col("asked"))
    return before.where(~F.col("request")).select(F.col("upstream").alias(upstream), F.col("id").alias(id_col), F.col("at").alias(order), asked.alias("asked"))
