"""Moves: one grouped operator an entity computes the recursion, detects at every scale and describes each move.

Bars are shuffled once; within the operator everything is an array of that entity's bars.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import kernels as K
from panelspark.shipping import ship
from panelspark.sources.bars import KEY, benchmark, trailing

SCALES = (2.0, 6.0, 15.0)
PRIMARY = "trail_6"
MOVE = "entity_id long, scale string, trail_atr double, direction string, trough_idx int, peak_idx int, resolved_idx int, start_date date, peak_date date, resolved_date date, is_open boolean"
DESCRIBED = MOVE + ", " + ", ".join(f"{d} double" for d in K.DESCRIPTORS)


def per_entity(bars: DataFrame, run: Callable[[dict[str, np.ndarray]], dict[str, list]], schema: str, key: str = KEY) -> DataFrame:
    """Applies run to each entity's bars, sorted by date, as arrays; run returns columns of rows."""
    names = [c for c in bars.columns if c != key]
    types = bars.sparkSession.createDataFrame([], schema).schema
    arrow = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in types.fields])

    def apply(keys, table):
        table = table.sort_by("date")
        series = {}
        for name in names:
            column = table.column(name).combine_chunks()
            series[name] = column if pa.types.is_date(column.type) or pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False).astype(float)
        rows = run(series)
        n = len(next(iter(rows.values())))
        rows = {key: [keys[0].as_py()] * n} | rows
        return pa.Table.from_arrays([_column(rows[f.name], f.type) for f in arrow], schema=arrow)

    ship(bars.sparkSession)
    return bars.groupBy(key).applyInArrow(apply, schema)


def _arrow(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "date": pa.date32(), "boolean": pa.bool_(), "string": pa.string()}[name]


def _column(values, kind: pa.DataType) -> pa.Array:
    """NaN never leaves an operator: it becomes null."""
    if kind == pa.float64():
        return pa.array(np.asarray(values, dtype=float), kind, from_pandas=True)
    return pa.array(values.tolist() if isinstance(values, np.ndarray) else values, kind)


def recursions(bars: DataFrame) -> DataFrame:
    """entity_id, date and each smoothed series of every bar, rounded to 8 digits."""

    def run(s):
        high, low, close = s["high"], s["low"], s["close"]
        found = {"wilder_atr_14": K.wilder_atr(high, low, close, 14), "wilder_atr_21": K.wilder_atr(high, low, close, 21), "ema_8": K.ema(close, 8), "ema_21": K.ema(close, 21)}
        found |= {"ewm_atr_21": K.ewm(K.true_ranges(high, low, close), 1 / 21), "ewm_21": K.ewm(close, 2 / 22), "rsi_14": K.wilder_rsi(close, 14)}
        return {"date": s["date"].to_pylist()} | {k: np.round(v, 8) for k, v in found.items()}

    names = "wilder_atr_14 wilder_atr_21 ema_8 ema_21 ewm_atr_21 ewm_21 rsi_14".split()
    return per_entity(bars.select(KEY, "date", "high", "low", "close"), run, "entity_id long, date date, " + ", ".join(f"{n} double" for n in names))


def _moves(s: dict, found: list[tuple[str, float, tuple[int, int, int]]]) -> dict[str, list]:
    dates = s["date"].to_pylist()
    out: dict[str, list] = {n: [] for n in "scale trail_atr direction trough_idx peak_idx resolved_idx start_date peak_date resolved_date is_open".split()}
    for scale, k, (start, peak, resolved) in found:
        closed = resolved >= 0
        row = (scale, k, "up", start, peak, resolved if closed else None, dates[start], dates[peak], dates[resolved] if closed else None, not closed)
        for name, value in zip(out, row, strict=True):
            out[name].append(value)
    return out


def scale_name(k: float) -> str:
    return f"trail_{k:g}"


def detect_moves(bars: DataFrame, scales: tuple[float, ...] = SCALES, atr_period: int = 21, min_duration: int = 1) -> DataFrame:
    """Moves of every entity at every scale, with their 32 descriptors."""
    bars = bars.withColumns({f"sma{p}": F.when(F.count("close").over(trailing(p - 1)) == p, F.avg("close").over(trailing(p - 1))) for p in (50, 200)})
    bars = bars.join(benchmark(bars), "date", "left") if "bench_close" not in bars.columns else bars

    def run(s):
        atr = K.wilder_atr(s["high"], s["low"], s["close"], atr_period)
        found = [(scale_name(k), k, m) for k in scales for m in K.trailing_stop_moves(s["close"], atr, k, min_duration)]
        rows = _moves(s, found)
        described = [K.describe_path(s["close"][a : b + 1]) | K.describe_company(s, a, b) for _, _, (a, b, _) in found]
        return rows | {d: [x[d] for x in described] for d in K.DESCRIPTORS}

    return per_entity(bars.select(KEY, "date", "open", "high", "low", "close", "volume", "bench_close", "sma50", "sma200"), run, DESCRIBED)


def detect_swings(bars: DataFrame, atr_period: int = 21, **options) -> DataFrame:
    """Moves of the swing baseline: confirmed by rise, ended by a fall from the peak."""

    def run(s):
        atr = K.wilder_atr(s["high"], s["low"], s["close"], atr_period)
        found = [("atr_swing", 3.0, m) for m in K.swing_moves(s["close"], atr, **options)]
        paths = [s["close"][a : b + 1] for _, _, (a, b, _) in found]
        return _moves(s, found) | {"trough_gain_pct": [float(p[-1] / p[0] - 1) for p in paths], "max_intra_drawdown": [float(K.drawdowns(p).max()) for p in paths]}

    return per_entity(bars.select(KEY, "date", "high", "low", "close"), run, MOVE + ", trough_gain_pct double, max_intra_drawdown double")


def theme_moves(composite: DataFrame, half_range: float = 0.005, **options) -> DataFrame:
    """Moves of composite series (entity_id, date, close): highs and lows stand half a percent off."""
    close = F.col("close")
    bars = composite.select(KEY, "date", close.alias("open"), (close * (1 + half_range)).alias("high"), (close * (1 - half_range)).alias("low"), "close", F.lit(0.0).alias("volume"), F.lit(None).cast("double").alias("bench_close"))
    return detect_moves(bars, **options)
