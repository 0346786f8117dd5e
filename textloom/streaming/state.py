"""Stateful streams: rate limits and duplicates by key, and the stateless pipeline over a stream.

State is bounded for each key (a window's start and count; the last answers). With `idle_ms` a key's state goes when
nothing has come for so long; such a stream has no end of its own, as it waits for keys to grow idle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators.dedup import Answers
from textloom.operators.session import LIMIT, WINDOW_MS, RateWindow
from textloom.runtime import ship


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def rate_limit(events: DataFrame, key: str, time: str, *, id_col: str = "event_id", limit: int = LIMIT, width: int = WINDOW_MS, idle_ms: int | None = None) -> DataFrame:
    """id, key, status as events come; within a micro-batch in order of time."""
    ship(events.sparkSession)
    kinds = dict(events.dtypes)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window = RateWindow(*state.get) if state.exists else RateWindow()
        rows = pd.concat(list(parts)).sort_values(["at", "id"], kind="stable")
        status = [window.admit(int(at), limit, width) for at in rows["at"]]
        state.update((window.start, window.count))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({id_col: rows["id"], key: rows["key"], "status": status})

    own = events.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.unix_millis(F.col(time).cast("timestamp")).alias("at"))
    return own.groupBy("key").applyInPandasWithState(step, f"{id_col} {kinds[id_col]}, {key} {kinds[key]}, status int", "start long, count long", "append", _timeout(idle_ms))


def mark_duplicates(texts: DataFrame, session: str, order: str, *, text_col: str = "text", threshold: float = 0.8, idle_ms: int | None = None) -> DataFrame:
    """session, order, marker as texts come; within a micro-batch in order."""
    ship(texts.sparkSession)
    kinds = dict(texts.dtypes)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        answers = Answers(threshold, (lambda s: (s[0], [tuple(x) for x in s[1]]))(json.loads(state.get[0]))) if state.exists else Answers(threshold)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        marks = [answers.check(t or "") for t in rows[text_col]]
        state.update((json.dumps(answers.state),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({session: rows[session], order: rows[order], "marker": pd.Series(marks, dtype=object, index=rows.index)})

    return texts.select(session, order, text_col).groupBy(session).applyInPandasWithState(step, f"{session} {kinds[session]}, {order} {kinds[order]}, marker string", "held string", "append", _timeout(idle_ms))


def windowed_counts(events: DataFrame, time: str, by: str, *, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by window and key with a watermark: an addition to what the batch operators do."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def answered(requests: DataFrame, responses: DataFrame, id_col: str, time: str, *, within: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """id, asked_at, answered_at: a stream-stream join of requests with responses that follow within some time; both
    sides' watermarks let rows go that can't meet any more."""
    asked = requests.select(F.col(id_col).alias("id"), F.col(time).cast("timestamp").alias("asked_at")).withWatermark("asked_at", late)
    told = responses.select(F.col(id_col).alias("answered_id"), F.col(time).cast("timestamp").alias("answered_at")).withWatermark("answered_at", late)
    meet = F.expr(f"id = answered_id AND answered_at >= asked_at AND answered_at <= asked_at + INTERVAL {within}")
    return asked.join(told, meet).select(F.col("id").alias(id_col), "asked_at", "answered_at")


def run_to_end(stream: DataFrame, to: str, checkpoint: str) -> None:
    """All that is there now, in append mode, as a Parquet table."""
    stream.writeStream.outputMode("append").format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
