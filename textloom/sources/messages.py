"""Messages as JSON lines, and what becomes of their results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textloom.config import EngineConfig
from textloom.functions import shield
from textloom.functions.text import estimate_tokens, length16
from textloom.operators.compress import compress
from textloom.operators.dedup import replay
from textloom.runtime import ship

SCHEMA = "id string, method string, params struct<name:string, arguments:map<string,string>>, result struct<content:array<struct<type:string, text:string>>, isError:boolean>"
#: Shorter results and arguments are left alone, and so are longer lines.
LEAST, LONGEST_LINE = 200, 4 * 1024 * 1024
POLICIES = ("proxy", "embedded", "router")


def parse(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """lines with `message`; lines over 4 MiB and lines that are no JSON objects are dropped."""
    own = lines.where(F.length(line_col) <= LONGEST_LINE)
    return own.withColumn("message", F.from_json(line_col, SCHEMA)).where(F.col("message").isNotNull())


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def reduce_results(df: DataFrame, session: str, order: str, *, policy: str = "proxy", mode: str = "aggressive", cfg: EngineConfig | None = None, text_col: str = "text") -> DataFrame:
    """session, order, text, tokens_saved: result texts after a policy.

    proxy and embedded block injections and mark duplicates within a session first. JSON is written anew by the policy
    and all else compressed. Texts under 200 characters stay as they are and aren't remembered (router: all are taken).
    """
    if policy not in POLICIES:
        raise ValueError(f"policies are {', '.join(POLICIES)}")
    cfg = cfg or EngineConfig()
    ship(df.sparkSession)
    own = df.select(session, order, F.col(text_col).alias("text"))
    short = own.where((length16(F.col("text")) < LEAST) | F.col("text").isNull()) if policy != "router" else own.where(F.col("text").isNull())
    long = own.where(length16(F.col("text")) >= LEAST) if policy != "router" else own.where(F.col("text").isNotNull())
    if policy == "router":
        marked = long.withColumns({"scanned": F.col("text"), "marker": F.lit(None).cast("string")})
    else:
        seen = shield.scan(long).drop("n_blocked")
        marks = replay(seen, session, order, text_col="scanned", threshold=cfg.dedup_threshold)
        marked = seen.join(marks, [session, order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textloom.functions.json_shred import prune_message

        for batch in batches:
            out = []
            for text, marker in zip(batch.column("scanned").to_pylist(), batch.column("marker").to_pylist(), strict=True):
                try:
                    out.append(None if marker else prune_message(text, policy))
                except (ValueError, RecursionError):
                    out.append(None)
            yield batch.append_column("json", pa.array(out, pa.string()))

    pruned = marked.mapInArrow(run, StructType([*marked.schema.fields, StructField("json", StringType())]))
    done = compress(pruned.withColumn("todo", F.when(F.col("marker").isNull() & F.col("json").isNull(), F.col("scanned"))), mode, cfg, text_col="todo")
    out = done.select(session, order, F.coalesce("marker", "json", "compressed").alias("out"), "text", "marker")
    saved = F.when(F.col("marker").isNull(), F.greatest(F.lit(0), estimate_tokens(F.col("text")) - estimate_tokens(F.col("out")))).otherwise(0)
    return out.select(session, order, F.col("out").alias("text"), saved.cast("long").alias("tokens_saved")).unionByName(short.withColumn("tokens_saved", F.lit(0).cast("long")))


def compress_arguments(messages: DataFrame, mode: str = "aggressive", cfg: EngineConfig | None = None) -> DataFrame:
    """id, name, key, text, tokens_saved: arguments of calls; long ones compressed where that saves tokens."""
    args = messages.where("message.method = 'tools/call'").select("message.id", "message.params.name", F.explode("message.params.arguments").alias("key", "value"))
    done = compress(args, mode, cfg, text_col="value")
    saved = estimate_tokens(F.col("value")) - estimate_tokens(F.col("compressed"))
    better = (length16(F.col("value")) >= LEAST) & (saved > 0)
    return done.select("id", "name", "key", F.when(better, F.col("compressed")).otherwise(F.col("value")).alias("text"), F.when(better, saved).otherwise(0).cast("long").alias("tokens_saved"))


def upstream_stats(saved: DataFrame, by: str) -> DataFrame:
    """Requests and tokens saved by upstream."""
    return saved.groupBy(by).agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens_saved").alias("tokens_saved"))


def memo_key(method: str, params: str) -> str:
    """SQL of a message's cache key: SHA-256 of its method and parameters."""
    return f"sha2(to_json(named_struct('method', {method}, 'params', {params})), 256)"
