"""Streams: bars from events, late data, and moves emitted as they resolve."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def _bars(events: DataFrame, window: Column) -> DataFrame:
    price = F.col("value")
    grouped = events.groupBy(F.col("user_id").alias("entity_id"), window.alias("w"))
    return grouped.agg(F.min_by(price, "ts").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "ts").alias("close"), F.count("*").cast("double").alias("volume"))


def event_bars(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str | None = "2 days") -> DataFrame:
    """Tumbling (or sliding) bars of events by user. On a stream, rows later than the watermark are dropped; a batch keeps all."""
    if late and events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = _bars(events, F.window("ts", width, slide) if slide else F.window("ts", width))
    return rows.select("entity_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "open", "high", "low", "close", "volume")


def event_sessions(events: DataFrame, gap: str = "1 hour", late: str | None = "2 days") -> DataFrame:
    """Sessions of a user's events that lie within gap of each other."""
    if late and events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = _bars(events, F.session_window("ts", gap))
    return rows.select("entity_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "open", "close", "volume")


MOVES = "entity_id long, start_idx int, peak_idx int, resolved_idx int, magnitude double"
STATE = "n int, start int, start_close double, peak int, peak_close double, prior_close double, seed_sum double, atr double"


def resolve_moves(k: float, period: int = 21):
    """The update of one entity's detector: a few numbers of state, bars in time order, moves out when their stop fires."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, start, s_close, peak, p_close, prior, seed, atr = state.get if state.exists else (0, 0, 0.0, 0, 0.0, float("nan"), 0.0, float("nan"))
        out = []
        frame = pd.concat(list(batches)).sort_values("date")
        for high, low, close in zip(frame["high"], frame["low"], frame["close"], strict=True):
            before = close if n == 0 else prior
            tr = max(high - low, abs(high - before), abs(low - before))
            if n < period:
                seed += tr
                atr = seed / period if n == period - 1 else float("nan")
            else:
                atr += (tr - atr) / period
            if n == 0 or (p_close <= s_close and close < s_close):
                start, s_close, peak, p_close = n, close, n, close
            elif close > p_close:
                peak, p_close = n, close
            elif p_close > s_close and close < p_close - k * atr:
                out.append((key[0], start, peak, n, p_close / s_close - 1))
                start, s_close, peak, p_close = n, close, n, close
            prior, n = close, n + 1
        state.update((n, start, s_close, peak, p_close, prior, seed, atr))
        yield pd.DataFrame(out, columns=["entity_id", "start_idx", "peak_idx", "resolved_idx", "magnitude"]).astype({"entity_id": "int64", "start_idx": "int32", "peak_idx": "int32", "resolved_idx": "int32", "magnitude": "float64"})

    return update


def stream_moves(bars: DataFrame, k: float = 6.0, period: int = 21) -> DataFrame:
    """Resolved moves of a stream of bars (entity_id, date, high, low, close) that arrive in date order for each entity."""
    return bars.groupBy("entity_id").applyInPandasWithState(resolve_moves(k, period), MOVES, STATE, "append", "NoTimeout")


def run_to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a bounded stream to its end into a table in memory; for tests."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
