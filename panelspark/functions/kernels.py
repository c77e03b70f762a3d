"""Recursions and state machines over one entity's bars, as numpy arrays in, arrays or rows out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

NAN = float("nan")


def true_ranges(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    """Ranges against the previous close; the first bar stands against its own close."""
    before = np.concatenate([close[:1], close[:-1]])
    return np.maximum.reduce([high - low, np.abs(high - before), np.abs(low - before)])


def seeded(x: np.ndarray, period: int, weight: float) -> np.ndarray:
    """y = y + weight * (x - y), started at the mean of the first period values; NaN before that."""
    out = np.full(len(x), NAN)
    if len(x) < period:
        return out
    level = out[period - 1] = float(np.mean(x[:period]))
    for i in range(period, len(x)):
        level += weight * (x[i] - level)
        out[i] = level
    return out


def wilder_atr(high, low, close, period: int = 14) -> np.ndarray:
    return seeded(true_ranges(high, low, close), period, 1.0 / period)


def ema(x: np.ndarray, period: int) -> np.ndarray:
    return seeded(x, period, 2.0 / (period + 1))


def ewm(x: np.ndarray, alpha: float) -> np.ndarray:
    """The same recursion started at the first value, without warm-up."""
    return seeded(x, 1, alpha)


def wilder_rsi(close: np.ndarray, period: int = 14) -> np.ndarray:
    change = np.diff(close)
    gain, loss = seeded(np.maximum(change, 0.0), period, 1.0 / period), seeded(np.maximum(-change, 0.0), period, 1.0 / period)
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.where(loss == 0, np.where(gain > 0, 100.0, 50.0), 100.0 - 100.0 / (1.0 + gain / loss))
    return np.concatenate([[NAN], np.where(np.isnan(gain), NAN, rsi)])


def trailing_stop_moves(close: np.ndarray, atr: np.ndarray, k: float, min_duration: int = 1) -> Iterator[tuple[int, int, int]]:
    """(start, peak, resolved) of each advance that a stop k ATR below its peak ends; resolved is -1 for the open one.

    While the peak has not risen above the start, a lower close moves the start. The bar on which the stop fires starts
    the next search. A bar without an ATR cannot fire the stop.
    """
    start = peak = 0
    for i in range(1, len(close)):
        risen = close[peak] > close[start]
        if close[i] > close[peak]:
            peak = i
        elif not risen:
            if close[i] < close[start]:
                start = peak = i
        elif close[i] < close[peak] - k * atr[i]:  # False where the ATR is NaN
            if peak - start >= min_duration:
                yield start, peak, i
            start = peak = i
    if len(close) and close[peak] > close[start] and peak - start >= min_duration:
        yield start, peak, -1


def swing_moves(close: np.ndarray, atr: np.ndarray, rise_atr: float = 3.0, rise: float = 0.10, fall: float = 0.20, min_duration: int = 10) -> Iterator[tuple[int, int, int]]:
    """(trough, peak, resolved) of advances confirmed by a rise from the lowest close and ended by a fall from the peak."""
    low, peak = 0, -1  # peak < 0: seeking
    for i in range(1, len(close)):
        if peak < 0:
            if close[i] < close[low]:
                low = i
            elif close[low] > 0 and close[i] - close[low] >= rise_atr * atr[low] and close[i] / close[low] - 1.0 >= rise:
                peak = low + int(np.argmax(close[low : i + 1]))
        elif close[i] > close[peak]:
            peak = i
        elif (close[peak] - close[i]) / close[peak] >= fall:
            if peak - low >= min_duration:
                yield low, peak, i
            low, peak = i, -1
    if peak >= 0 and peak - low >= min_duration:
        yield low, peak, -1


def _efficiency(path: np.ndarray) -> float:
    travelled = float(np.abs(np.diff(path)).sum())
    return float(path[-1] - path[0]) / travelled if travelled > 0 else 0.0


def drawdowns(path: np.ndarray) -> np.ndarray:
    top = np.maximum.accumulate(path)
    return np.where(top > 0, (top - path) / np.where(top > 0, top, 1.0), 0.0)


def retracements(drawdown: np.ndarray, deep: float, recovered: float) -> list[float]:
    """Depths of separate pullbacks: one begins beyond deep and ends only below recovered."""
    depths: list[float] = []
    inside = False
    for d in drawdown:
        if inside and d < recovered:
            inside = False
        elif inside:
            depths[-1] = max(depths[-1], float(d))
        elif d > deep:
            depths.append(float(d))
            inside = True
    return depths


def longest_run(flags: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def describe_path(path: np.ndarray) -> dict[str, float]:
    """What the closes of one move say about it; the path runs from start to peak."""
    n, first, last = len(path), float(path[0]), float(path[-1])
    duration, gain = n - 1, last / first - 1.0
    returns = np.diff(path) / path[:-1] if n > 1 else np.zeros(1)
    fall = drawdowns(path)
    third = max(2, n // 3)
    pulls = retracements(fall, 0.05, 0.025)
    halfway = float(path[max(1, n // 2)]) / first - 1.0 if n > 1 else 0.0
    smooth = _efficiency(path)
    orderly, large, lasting = min(1.0, max(0.0, smooth)), gain / (gain + 0.5) if gain > 0 else 0.0, duration / (duration + 63.0)
    spread = float(returns.std())
    jumps = np.abs(returns)
    return {
        "magnitude": gain, "log_magnitude": float(np.log(last / first)), "duration_days": float(duration), "velocity": gain / max(1, duration),
        "annualized_return": float(min((last / first) ** (252.0 / max(1, duration)) - 1.0, 1e4)),
        "smoothness": smooth, "early_smoothness": _efficiency(path[:third]), "late_smoothness": _efficiency(path[-third:]),
        "mae": max(0.0, (first - float(path.min())) / first), "max_intra_drawdown": float(fall.max()),
        "drawdown_timing": float(np.argmax(fall)) / duration if duration and fall.max() > 0 else 0.0,
        "trend_quality": float((orderly * large * lasting) ** (1.0 / 3.0)),
        "num_pullbacks": float(len(pulls)), "largest_pullback": max(pulls, default=0.0), "mean_pullback": float(np.mean(pulls)) if pulls else 0.0,
        "up_day_share": float(np.mean(returns > 0)), "max_up_streak": float(longest_run(returns > 0)), "max_down_streak": float(longest_run(returns < 0)),
        "return_skew": float(np.mean(((returns - returns.mean()) / spread) ** 3)) if len(returns) >= 3 and spread > 0 else 0.0,
        "front_loaded_ratio": float(np.clip(halfway / gain, -1.0, 2.0)) if abs(gain) > 0.05 else NAN,
        "big_day_count": float((jumps > 0.05).sum()) if n > 1 else NAN, "largest_big_day": float(jumps.max()) if n > 1 else NAN,
    }


def describe_company(s: dict[str, np.ndarray], start: int, peak: int) -> dict[str, float]:
    """What opens, volumes, averages and the benchmark say about the move from start to peak."""
    close, volume, bench = s["close"], s["volume"], s["bench_close"]
    path, traded = close[start : peak + 1], volume[start : peak + 1]
    n = len(path)
    change = np.diff(path)
    out = dict.fromkeys(("overnight_gap_count", "largest_overnight_gap", "vol_expansion", "up_down_vol_ratio", "vol_trend", "rs_move", "rs_at_peak_is_high", "pct_days_above_sma50", "pct_days_above_sma200"), NAN)
    if n > 1:
        gaps = np.abs(s["open"][start + 1 : peak + 1] / path[:-1] - 1.0)
        gaps = gaps[np.isfinite(gaps)]
        if len(gaps):
            out |= {"overnight_gap_count": float((gaps > 0.05).sum()), "largest_overnight_gap": float(gaps.max())}
        sold = traded[1:][change < 0].sum()
        if sold > 0:
            out["up_down_vol_ratio"] = float(traded[1:][change > 0].sum() / sold)
    before = volume[max(0, start - 63) : start]
    if len(before) and before.mean() > 0:
        out["vol_expansion"] = float(traded.mean() / before.mean())
    if n > 2 and traded.mean() > 0:
        x = np.arange(n) - (n - 1) / 2
        out["vol_trend"] = float((x * traded).sum() / (x * x).sum() / traded.mean())
    line = np.where(bench[start : peak + 1] > 0, path / np.where(bench[start : peak + 1] > 0, bench[start : peak + 1], 1.0), NAN)
    if bench[start] > 0 and bench[peak] > 0:
        out["rs_move"] = float((path[-1] / path[0]) / (bench[peak] / bench[start]) - 1.0)
        out["rs_at_peak_is_high"] = float(line[-1] >= np.nanmax(line))
    for period in (50, 200):
        mean = s[f"sma{period}"][start : peak + 1]
        known = ~np.isnan(mean)
        if known.any():
            out[f"pct_days_above_sma{period}"] = float((path[known] > mean[known]).mean())
    with np.errstate(invalid="ignore"):
        below = np.flatnonzero(path < s["sma50"][start : peak + 1])
    out["first_close_below_sma50_frac"] = float(below[0]) / max(1, n - 1) if len(below) else 1.0
    return out


DESCRIPTORS = (
    "magnitude log_magnitude duration_days velocity annualized_return smoothness early_smoothness late_smoothness mae max_intra_drawdown drawdown_timing trend_quality "
    "num_pullbacks largest_pullback mean_pullback up_day_share max_up_streak max_down_streak return_skew front_loaded_ratio big_day_count largest_big_day "
    "overnight_gap_count largest_overnight_gap vol_expansion up_down_vol_ratio vol_trend rs_move rs_at_peak_is_high pct_days_above_sma50 pct_days_above_sma200 first_close_below_sma50_frac"
).split()
