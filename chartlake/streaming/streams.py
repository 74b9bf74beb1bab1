"""Structured Streaming: upserts into a table of points, windowed statistics, sessions and rate limits.

Event time must be TIMESTAMP; TIMESTAMP_NTZ columns are cast by event_time().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import store


def event_time(rows: DataFrame, col: str = "ts") -> DataFrame:
    return rows.withColumn(col, F.col(col).cast("timestamp"))


def upsert_batches(read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], id_col: str = "vec_id", time_col: str = "ts"):
    """A foreachBatch function: the latest row of each id in the batch replaces the table's."""

    def apply(batch: DataFrame, epoch: int) -> None:
        new = store.latest(batch, [F.desc(time_col)], id_col)
        now = read()
        write(new if now is None else store.upsert(now, new, id_col), epoch)

    return apply


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = event_time(events).withWatermark("ts", late).groupBy(span.alias("w"), key)
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    rows = event_time(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key)
    return rows.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rate_limited(events: DataFrame, limit: int = 100, seconds: float = 60.0, key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """(key, ts, allowed): at most `limit` allowed events of a key in any `seconds`; state holds the allowed times."""

    def decide(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches), ignore_index=True).sort_values("ts", kind="stable")
        allowed = []
        for t in rows["ts"].map(lambda x: x.timestamp()):
            held = [x for x in held if x > t - seconds]
            allowed.append(len(held) < limit)
            if allowed[-1]:
                held.append(t)
        state.update((held,))
        yield pd.DataFrame({key: rows[key], "ts": rows["ts"], "allowed": allowed})

    rows = event_time(events).select(key, "ts").withWatermark("ts", late)
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(decide, f"{key} {kind}, ts timestamp, allowed boolean", "times array<double>", "append", "NoTimeout")


def decay_mean(events: DataFrame, alpha: float = 0.2, key: str = "event_type") -> DataFrame:
    """(key, n, mean): an exponentially weighted mean per key that each batch carries on, in order of time."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.0)
        for value in pd.concat(list(batches), ignore_index=True).sort_values("ts", kind="stable")["value"].dropna():
            mean = value if n == 0 else (1 - alpha) * mean + alpha * value
            n += 1
        state.update((n, mean))
        yield pd.DataFrame({key: [name[0]], "n": [n], "mean": [mean]})

    rows = event_time(events).select(key, "ts", "value")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} string, n long, mean double", "n long, mean double", "update", "NoTimeout")
