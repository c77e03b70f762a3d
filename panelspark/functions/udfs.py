"""SQL functions: registered array recursions and a table function that detects moves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, DoubleType

from panelspark.functions import kernels as K


def _arrays(run, *columns: pd.Series) -> pd.Series:
    out = []
    for row in zip(*columns, strict=True):
        values = run(*(np.asarray(v, dtype=float) if isinstance(v, (list, np.ndarray)) else v for v in row))
        out.append([None if x != x else float(x) for x in values])
    return pd.Series(out)


class DetectMoves:
    """SELECT * FROM detect_moves(high, low, close, k): start, peak and resolved index of each move of three arrays."""

    def eval(self, high, low, close, k):
        h, low_, c = (np.asarray(x, dtype=float) for x in (high, low, close))
        for start, peak, resolved in K.trailing_stop_moves(c, K.wilder_atr(h, low_, c, 21), float(k)):
            yield start, peak, resolved if resolved >= 0 else None


def register(spark: SparkSession) -> None:
    """wilder_atr(high, low, close, period), ema(values, period), wilder_rsi(close, period) over arrays, and detect_moves."""
    kind = ArrayType(DoubleType())

    def atr(high: pd.Series, low: pd.Series, close: pd.Series, period: pd.Series) -> pd.Series:
        return _arrays(lambda h, lo, c, p: K.wilder_atr(h, lo, c, int(p)), high, low, close, period)

    def ema(values: pd.Series, period: pd.Series) -> pd.Series:
        return _arrays(lambda v, p: K.ema(v, int(p)), values, period)

    def rsi(close: pd.Series, period: pd.Series) -> pd.Series:
        return _arrays(lambda c, p: K.wilder_rsi(c, int(p)), close, period)

    for name, f in (("wilder_atr", atr), ("ema", ema), ("wilder_rsi", rsi)):
        spark.udf.register(name, pandas_udf(f, kind))
    spark.udtf.register("detect_moves", udtf(DetectMoves, returnType="start_idx int, peak_idx int, resolved_idx int"))
