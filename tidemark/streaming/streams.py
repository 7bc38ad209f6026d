"""The batch operators that have a streaming form: weekly resample, as-of lookup, continuous periods."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def weekly_last(events: DataFrame, ts: str, key: str, value: str, late: str = "2 days") -> DataFrame:
    """Last value per key and week (weeks start on Saturday, so they end on a Friday), closed by the watermark."""
    week = F.window(ts, "7 days", "7 days", "2 days")  # the epoch was a Thursday
    return (
        events.withWatermark(ts, late)
        .groupBy(week.alias("w"), F.col(key))
        .agg(F.max_by(value, ts).alias(value), F.count(F.lit(1)).alias("n"))
        .select(key, F.col("w.end").alias("week_end"), value, "n")
    )


def stream_static_lookup(events: DataFrame, facts: DataFrame, key: str, ts: str, columns: list[str]) -> DataFrame:
    """Each event with the fact valid at its time. ``facts`` (key, valid_from, valid_to, columns) are disjoint half-open spans."""
    f = facts.select(F.col(key).alias("__k"), "valid_from", "valid_to", *columns)
    at = F.col(ts)
    on = (F.col(key) == F.col("__k")) & (at >= F.col("valid_from")) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    return events.join(f, on, "left").drop("__k", "valid_from", "valid_to")


SESSION_OUT = "key long, first_ts timestamp, last_ts timestamp, n long"


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Continuous activity per key under a custom state: a session is given out once the watermark is past its gap."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n = state.get
            state.remove()
            yield _row(k[0], first, last, n)
            return
        first, last, n = state.get if state.exists else (None, None, 0)
        done = []
        times = sorted(int(t.timestamp() * 1e6) for b in batches for t in b["ts"])
        for t in times:
            if last is not None and t - last > gap_seconds * 1_000_000:
                done.append((first, last, n))
                first, n = t, 0
            first = t if first is None else min(first, t)
            last = t if last is None else max(last, t)
            n += 1
        if last is not None:
            state.update((first, last, n))
            state.setTimeoutTimestamp(max(last // 1000 + gap_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        for one in done:
            yield _row(k[0], *one)

    rows = events.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(step, SESSION_OUT, "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def _row(key: int, first: int, last: int, n: int) -> pd.DataFrame:
    return pd.DataFrame({"key": [key], "first_ts": [pd.Timestamp(first, unit="us")], "last_ts": [pd.Timestamp(last, unit="us")], "n": [n]})
