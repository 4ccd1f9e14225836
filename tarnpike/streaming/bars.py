"""Streams: bars by event time with late data, forward fill and a trading state, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(ticks: DataFrame, symbol: str, ts: str, value: str, tie: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of tumbling windows; a bar is final when the watermark passes its end, later ticks are dropped. On a table, the batch result."""
    at = F.struct(F.col(ts), F.col(tie))
    rows = ticks.withWatermark(ts, late) if ticks.isStreaming else ticks
    x = rows.groupBy(F.col(symbol).alias("symbol"), F.window(ts, every).alias("_w")).agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").cast("double").alias("volume"))
    return x.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume", ((F.col("high") + F.col("low")) / 2).alias("mid"))


def stream_sessions(ticks: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key's ticks: start, end, ticks."""
    rows = ticks.withWatermark(ts, late) if ticks.isStreaming else ticks
    x = rows.groupBy(F.col(key), F.session_window(ts, gap).alias("_w")).agg(F.count("*").alias("ticks"))
    return x.select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "ticks")


def stream_runs(ticks: DataFrame, key: str, ts: str, value: str, level: float) -> DataFrame:
    """By key and micro-batch: how long the current run of values above ``level`` is, and the longest so far. The state is two numbers for each key."""

    def step(key_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, most = state.get if state.exists else (0, 0)
        for x in sorted((r for p in parts for r in p.itertuples(index=False)), key=lambda r: getattr(r, ts)):
            now = now + 1 if getattr(x, value) > level else 0
            most = max(most, now)
        state.update((now, most))
        yield pd.DataFrame({"key": [key_[0]], "run": [now], "longest": [most]})

    return ticks.groupBy(key).applyInPandasWithState(step, "key string, run long, longest long", "run long, longest long", "update", GroupStateTimeout.NoTimeout)
