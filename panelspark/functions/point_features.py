"""The features of windows.py at chosen bars of one entity, in numpy: what a window holds is read for those bars alone.

Missing numbers are NaN; sums, means and extremes pass over them as SQL's do.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from panelspark.functions.windows import GENERIC_LOOKBACKS, LOOKBACKS, MA_PERIODS

#: Features that windows.py leaves unrounded.
EXACT = ("dist_from_high", "dist_from_low", "base_depth", "range_position", "vol_ratio", "vol_surge", "vol_trend", "updown_vol", "accum_vol_share", "up_vs_down_vol_extreme")


def _div(a, b):
    return np.divide(a, b, out=np.full(np.broadcast_shapes(np.shape(a), np.shape(b)), np.nan), where=np.not_equal(b, 0))


def _lag(x: np.ndarray, k: int = 1) -> np.ndarray:
    return np.concatenate([np.full(min(k, len(x)), np.nan), x[: max(0, len(x) - k)]])


def _mean(w: np.ndarray) -> np.ndarray:
    whole = w.mean(1)
    some = np.isnan(whole)
    if some.any():
        part = w[some]
        whole[some] = _div(np.nansum(part, 1), (~np.isnan(part)).sum(1))
    return whole


def _top(w: np.ndarray) -> np.ndarray:
    return np.fmax.reduce(w, 1)


def _low(w: np.ndarray) -> np.ndarray:
    return np.fmin.reduce(w, 1)


class Windows:
    """Windows that end at, or some bars before, the bars at the given places."""

    def __init__(self, at: np.ndarray, longest: int):
        self.at, self.pad, self.padded, self.running, self.places = at, longest, {}, {}, {}

    def __call__(self, x: np.ndarray, n: int, lag: int = 0) -> np.ndarray:
        if id(x) not in self.padded:
            self.padded[id(x)] = x, np.concatenate([np.full(self.pad, np.nan), x])
        if (n, lag) not in self.places:
            self.places[n, lag] = (self.at + self.pad - lag - n + 1)[:, None] + np.arange(n)
        return self.padded[id(x)][1].take(self.places[n, lag])

    def sums(self, x: np.ndarray, n: int, lag: int = 0) -> np.ndarray:
        """A difference of two running sums, as windows.py takes it: exact for whole numbers."""
        if id(x) not in self.running:
            self.running[id(x)] = x, np.concatenate([[0.0], np.cumsum(np.where(np.isnan(x), 0.0, x))])
        total = self.running[id(x)][1]
        return total[np.maximum(self.at + 1 - lag, 0)] - total[np.maximum(self.at + 1 - lag - n, 0)]

    def full(self, x: np.ndarray, bars: int) -> np.ndarray:
        return np.where(self.at >= bars - 1, x, np.nan)


def _slope(i: np.ndarray, sy: np.ndarray, sxy: np.ndarray, n: int) -> np.ndarray:
    sx, sxx = n * i - n * (n - 1) // 2, n * i * i - i * (n * (n - 1)) + (n - 1) * n * (2 * n - 1) // 6
    return _div(n * sxy - sx * sy, (n * sxx - sx * sx).astype(float))


def _correlation(sums: Callable, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    both = ~(np.isnan(a) | np.isnan(b))
    a, b = np.where(both, a, 0.0), np.where(both, b, 0.0)
    c = sums(both.astype(float), n)
    ma, mb, maa, mbb, mab = (_div(sums(x, n), c) for x in (a, b, a * a, b * b, a * b))
    spread = (maa - ma * ma) * (mbb - mb * mb)
    return np.where(spread > 1e-24, _div(mab - ma * mb, np.sqrt(np.maximum(spread, 0.0))), np.nan)


def at_points(s: dict[str, np.ndarray], at: np.ndarray, lookbacks=LOOKBACKS, include_generic: bool = True) -> dict[str, np.ndarray]:
    """Each feature, not yet rounded, at the bars in at. s: high, low, close, volume and bench_close of all bars by date."""
    high, low, close, volume, line = (s[c] for c in ("high", "low", "close", "volume", "bench_close"))
    look = Windows(at, 2 * max(*lookbacks, *MA_PERIODS, *GENERIC_LOOKBACKS))
    full, sums, px, out = look.full, look.sums, close[at], {}
    i, index = at.astype(np.int64), np.arange(len(close), dtype=float)
    with np.errstate(all="ignore"):
        pc = _lag(close)
        rng, dr = high - low, close - pc
        tr = np.fmax(rng, np.fmax(np.abs(high - pc), np.abs(low - pc)))
        r = np.where((pc > 0) & (close > 0), np.log(close / pc), np.nan)
        clv = np.where(rng > 0, ((close - low) - (high - close)) / rng, 0.0)
        ups, downs = (np.where(test, volume, 0.0) for test in (dr > 0, dr < 0))
        up, down = (np.where(test, volume, np.nan) for test in (dr > 0, dr < 0))
        flow, vx = clv * volume, volume * index
        bench = np.where(line > 0, line, np.nan)
        rs = close / bench
        exact = np.floor(rs * 1e9 + 0.5) / 1e9  # decimals of nine digits
        exact_x = exact * index
        for n in lookbacks:
            half, w = n // 2, look(close, n)
            top, bottom = _top(w), _low(w)
            out[f"dist_from_high_{n}"], out[f"dist_from_low_{n}"] = full(_div(px, top) - 1, n), full(_div(px, bottom) - 1, n)
            out[f"base_depth_{n}"], out[f"range_position_{n}"] = full(_div(top - bottom, top), n), full(_div(px - bottom, top - bottom), n)
            w = look(r, n - 1)
            out[f"ret_std_{n}"] = full(np.sqrt(_div(np.nansum((w - _mean(w)[:, None]) ** 2, 1), np.maximum((~np.isnan(w)).sum(1) - 1.0, 0.0))), n)
            out[f"atr_pct_{n}"] = full(_mean(look(tr, n)) / px, n + 1)
            out[f"vol_contraction_{n}"] = full(_div(_mean(look(tr, half)), _mean(look(tr, half, half))), 2 * half + 1)
            total = sums(volume, n)
            mean = total / n
            out[f"vol_ratio_{n}"] = full(_div(mean, sums(volume, n, n) / n), 2 * n)
            out[f"vol_surge_{n}"] = full(_div(volume[at], mean), n)
            out[f"vol_trend_{n}"] = full(_div(_slope(i, total, sums(vx, n), n), mean), n)
            gained = sums(ups, n)
            out[f"updown_vol_{n}"], out[f"accum_vol_share_{n}"] = full(_div(gained, sums(downs, n)), n + 1), full(_div(gained, total), n + 1)
            out[f"up_vs_down_vol_extreme_{n}"] = full(_div(_top(look(up, n)), _top(look(down, n))), n + 1)
            out[f"cmf_{n}"] = full(_div(sums(flow, n), total), n)
            w = np.sort(look(rng, n), 1)
            median = w[:, n // 2] if n % 2 else (w[:, n // 2 - 1] + w[:, n // 2]) / 2
            out[f"tight_days_share_{n}"] = full(np.where(median > 0, (w < median[:, None]).sum(1) / n, np.nan), n)
            back, back_line = (np.where(x > 0, x, np.nan)[at] for x in (_lag(close, n), _lag(line, n)))
            out[f"rel_strength_{n}"] = px / back / (bench[at] / back_line) - 1
            w = look(rs, n)
            whole = ~np.isnan(w).any(1)
            mean = sums(exact, n) / n
            out[f"rs_line_slope_{n}"] = full(np.where(whole, _div(_slope(i, sums(exact, n), sums(exact_x, n), n), np.abs(mean)), np.nan), n)
            out[f"rs_at_high_{n}"] = full(np.where(whole, rs[at] / _top(w), np.nan), n)
        out["range_tightness"] = full(_div(_mean(look(tr, lookbacks[0])), _mean(look(tr, lookbacks[-1]))), lookbacks[-1] + 1)
        means = {n: full(_mean(look(close, n)), n) for n in MA_PERIODS}
        out |= {f"price_to_ma_{n}": _div(px, m) - 1 for n, m in means.items()}
        every = np.stack(list(means.values()), 1)
        out["ma_compression"] = full((_top(every) - _low(every)) / px, sorted(MA_PERIODS)[1])
        if include_generic:
            out |= _generic(look, close, volume, r)
    return out


def _generic(look: Windows, close: np.ndarray, volume: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    full, sums, out = look.full, look.sums, {}
    r1, v1, c1, c2 = _lag(r), _lag(volume), _lag(close), _lag(close, 2)
    flip = (~(np.isnan(r) | np.isnan(r1)) & (np.sign(r) != np.sign(r1))).astype(float)
    pattern = np.where(np.isnan(c2), np.nan, 4 * (c2 <= c1) + 2 * (c1 <= close) + (c2 <= close))
    r0, known = np.where(np.isnan(r), 0.0, r), (~np.isnan(r)).astype(float)
    powers, so_far = [r0, r0 * r0, r0 * r0 * r0, r0 * r0 * r0 * r0], np.cumsum(r0)
    for n in GENERIC_LOOKBACKS:
        c = sums(known, n - 1)
        m1, m2, m3, m4 = (_div(sums(x, n - 1), c) for x in powers)
        var = m2 - m1 * m1
        var = np.where(var > 1e-18, var, np.nan)
        out[f"ret_autocorr1_{n}"] = full(_correlation(sums, r, r1, n - 2), n)
        out[f"vol_autocorr1_{n}"] = full(_correlation(sums, volume, v1, n - 1), n)
        out[f"ret_skew_{n}"] = full((m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / (var * np.sqrt(var)), n)
        out[f"ret_kurt_{n}"] = full((m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / (var * var) - 3, n)
        out[f"zero_cross_{n}"] = full(np.where(np.isnan(var), np.nan, sums(flip, n - 2) / (n - 2)), n)
        w = look(pattern, n - 2)
        shares = np.stack([(w == p).sum(1) / (n - 2) for p in range(8)], 1)
        out[f"perm_entropy_{n}"] = full(np.where(shares > 0, -shares * np.log(np.where(shares > 0, shares, 1.0)), 0.0).sum(1) / np.log(6.0), n)
        walk = look(so_far, n - 1) - np.arange(n - 1) * m1[:, None]
        spread = _top(walk) - _low(walk)
        out[f"hurst_{n}"] = full(np.where(spread > 1e-12, np.log(spread / np.sqrt(var)) / np.log(float(n - 1)), np.nan), n)
    return out
