"""Window expressions over bars. Every look-back is guarded: where a window is not full, the value is null.

All share one order (entity_id by date), so a plan needs one shuffle and one sort for any number of features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.sources.bars import series, so_far, trailing

LOOKBACKS = (21, 42, 63, 126)
GENERIC_LOOKBACKS = (63, 126)
GROUP_LOOKBACKS = (21, 63, 126)
MA_PERIODS = (20, 50, 150, 200)
DIGITS = 6


def _r(x: Column) -> Column:
    return F.round(x, DIGITS)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def full(expr: Column, bars: int) -> Column:
    """expr where at least so many bars exist up to the row."""
    return F.when(F.col("i") >= bars - 1, expr)


def running(bars: DataFrame, **terms: Column) -> DataFrame:
    """Adds run_<name>, each term's sum over all bars so far. A window's sum is then a difference of two rows, whatever its
    length; sums of whole numbers and of decimals stay exact. Those that no feature reads are pruned."""
    return bars.withColumns({f"run_{n}": F.sum(t).over(so_far()) for n, t in terms.items()})


def window_sum(name: str, n: int, lag: int = 0) -> Column:
    """Sum of a running term over the n bars that end lag bars back."""
    at = lambda k: F.lag(f"run_{name}", k).over(series()) if k else F.col(f"run_{name}")
    before = F.lag(f"run_{name}", n + lag).over(series())
    return at(lag) - F.coalesce(before, F.lit(0))


def prepare(bars: DataFrame) -> DataFrame:
    """Adds what features share: bar index i, previous close pc, true range tr, log return r, change dr, range rng."""
    bars = bars.withColumns({"i": F.row_number().over(series()) - 1, "pc": F.lag("close").over(series())})
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("pc")), F.abs(F.col("low") - F.col("pc")))
    r = F.when((F.col("pc") > 0) & (F.col("close") > 0), F.log(F.col("close") / F.when(F.col("pc") > 0, F.col("pc"))))
    rng = F.col("high") - F.col("low")
    clv = F.when(rng > 0, ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / F.when(rng > 0, rng)).otherwise(0.0)
    bars = bars.withColumns({"tr": tr, "r": r, "dr": F.col("close") - F.col("pc"), "rng": rng, "clv": clv})
    up, down = (F.when(test, F.col("volume")).otherwise(0.0) for test in (F.col("dr") > 0, F.col("dr") < 0))
    return running(bars, v=F.col("volume"), vx=F.col("volume") * F.col("i"), up=up, down=down, flow=F.col("clv") * F.col("volume"))


def true_range() -> Column:
    """Range against the previous close; the first bar stands against its own close."""
    pc = F.coalesce(F.lag("close").over(series()), F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def sma(column: str, n: int) -> Column:
    return full(F.avg(column).over(trailing(n - 1)), n)


def distance(lookbacks=LOOKBACKS) -> dict[str, Column]:
    out = {}
    for n in lookbacks:
        w = trailing(n - 1)
        top, low, px = F.max("close").over(w), F.min("close").over(w), F.col("close")
        out[f"dist_from_high_{n}"] = full(safe_div(px, top) - 1, n)
        out[f"dist_from_low_{n}"] = full(safe_div(px, low) - 1, n)
        out[f"base_depth_{n}"] = full(safe_div(top - low, top), n)
        out[f"range_position_{n}"] = full(safe_div(px - low, top - low), n)
    return out


def volatility(lookbacks=LOOKBACKS) -> dict[str, Column]:
    out = {}
    for n in lookbacks:
        half = n // 2
        out[f"ret_std_{n}"] = _r(full(F.stddev_samp("r").over(trailing(n - 2)), n))
        out[f"atr_pct_{n}"] = _r(full(F.avg("tr").over(trailing(n - 1)) / F.col("close"), n + 1))
        recent, earlier = F.avg("tr").over(trailing(half - 1)), F.avg("tr").over(trailing(2 * half - 1, half))
        out[f"vol_contraction_{n}"] = _r(full(safe_div(recent, earlier), 2 * half + 1))
    short, long = F.avg("tr").over(trailing(lookbacks[0] - 1)), F.avg("tr").over(trailing(lookbacks[-1] - 1))
    out["range_tightness"] = _r(full(safe_div(short, long), lookbacks[-1] + 1))
    return out


def _slope(y: str, xy: str, n: int) -> Column:
    """Least-squares slope on the bar index over a full window of n bars, from running sums of y and of y times the index."""
    i = F.col("i").cast("long")
    sx, sxx = n * i - n * (n - 1) // 2, n * i * i - i * (n * (n - 1)) + (n - 1) * n * (2 * n - 1) // 6
    sy, sxy = window_sum(y, n).cast("double"), window_sum(xy, n).cast("double")
    return (n * sxy - sx * sy) / (n * sxx - sx * sx)


def volume(lookbacks=LOOKBACKS) -> dict[str, Column]:
    out = {}
    up, down = F.when(F.col("dr") > 0, F.col("volume")), F.when(F.col("dr") < 0, F.col("volume"))
    for n in lookbacks:
        w = trailing(n - 1)
        total = window_sum("v", n)
        mean = total / n
        out[f"vol_ratio_{n}"] = full(safe_div(mean, window_sum("v", n, n) / n), 2 * n)
        out[f"vol_surge_{n}"] = full(safe_div(F.col("volume"), mean), n)
        out[f"vol_trend_{n}"] = full(safe_div(_slope("v", "vx", n), mean), n)
        ups, downs = window_sum("up", n), window_sum("down", n)
        out[f"updown_vol_{n}"] = full(safe_div(ups, downs), n + 1)
        out[f"accum_vol_share_{n}"] = full(safe_div(ups, total), n + 1)
        out[f"up_vs_down_vol_extreme_{n}"] = full(safe_div(F.max(up).over(w), F.max(down).over(w)), n + 1)
        out[f"cmf_{n}"] = _r(full(safe_div(window_sum("flow", n), total), n))
    return out


def _share_below_median(values: Column, n: int) -> Column:
    """Share of n values below their median; null where the median is not positive. One sort of the window's list."""

    def of(x: Column) -> Column:
        median = F.get(x, n // 2) if n % 2 else (F.get(x, n // 2 - 1) + F.get(x, n // 2)) / 2
        return F.when(median > 0, F.size(F.filter(x, lambda v: v < median)) / F.lit(n))

    return F.transform(F.array(F.array_sort(values)), of)[0]


def _cumulated_range(sums: Column, mean: Column) -> Column:
    """The range of cumulated deviations from the mean, from a window's running sums."""
    deviations = F.transform(sums, lambda x, k: x - k * mean)
    return F.transform(F.array(deviations), lambda d: F.array_max(d) - F.array_min(d))[0]


def tightness(lookbacks=LOOKBACKS) -> dict[str, Column]:
    """Share of bars whose range is below the window's median range."""
    out = {}
    for n in lookbacks:
        w = trailing(n - 1)
        out[f"tight_days_share_{n}"] = _r(full(_share_below_median(F.collect_list("rng").over(w), n), n))
    return out


def averages() -> dict[str, Column]:
    means = {n: full(F.avg("close").over(trailing(n - 1)), n) for n in MA_PERIODS}
    out = {f"price_to_ma_{n}": _r(safe_div(F.col("close"), m) - 1) for n, m in means.items()}
    out["ma_compression"] = _r(full((F.greatest(*means.values()) - F.least(*means.values())) / F.col("close"), sorted(MA_PERIODS)[1]))
    return out


def with_line(bars: DataFrame, line: str, name: str) -> DataFrame:
    """Adds the running sums of close over a line, as decimals, that relative strength needs."""
    exact = (F.col("close") / F.when(F.col(line) > 0, F.col(line))).cast("decimal(18,9)")
    rows = running(bars, **{name: exact, f"{name}_x": exact * F.col("i").cast("decimal(10,0)"), f"{name}_n": F.when(exact.isNotNull(), 1).otherwise(0)})
    return rows.withColumns({f"run_{c}": F.col(f"run_{c}").cast("decimal(30,9)") for c in (name, f"{name}_x")})  # room to subtract


def relative_strength(lookbacks=LOOKBACKS, line: str = "bench_close", name: str = "rs") -> dict[str, Column]:
    """Against a benchmark column; a window with a missing benchmark has no slope and no high. Bars come from with_line()."""
    out = {}
    bench = F.when(F.col(line) > 0, F.col(line))
    rs = F.col("close") / bench
    for n in lookbacks:
        back, back_line = F.lag("close", n).over(series()), F.lag(line, n).over(series())
        own = F.col("close") / F.when(back > 0, back)
        out[f"rel_strength_{n}"] = _r(own / (bench / F.when(back_line > 0, back_line)) - 1)
        whole = window_sum(f"{name}_n", n) == n
        mean = window_sum(name, n).cast("double") / n
        out[f"rs_line_slope_{n}"] = _r(full(F.when(whole, safe_div(_slope(name, f"{name}_x", n), F.abs(mean))), n))
        out[f"rs_at_high_{n}"] = _r(full(F.when(whole, rs / F.max(rs).over(trailing(n - 1))), n))
    return out


def group_strength(lookbacks=GROUP_LOOKBACKS) -> dict[str, Column]:
    """Entity against sector_close, and sector_close against bench_close. Bars come from with_line(.., "sector_close", "sec")."""
    out = {}
    ratio = lambda a, b, n: (F.col(a) / F.lag(a, n).over(series())) / (F.col(b) / F.lag(b, n).over(series())) - 1
    for n in lookbacks:
        out[f"sector_rs_{n}"] = _r(ratio("close", "sector_close", n))
        mean = window_sum("sec", n).cast("double") / n
        out[f"sector_rs_slope_{n}"] = _r(full(F.when(window_sum("sec_n", n) == n, safe_div(_slope("sec", "sec_x", n), F.abs(mean))), n))
        out[f"group_strength_{n}"] = _r(ratio("sector_close", "bench_close", n))
    return out


def _lag_correlation(name: str, n: int) -> Column:
    """Pearson of a series with its lag over the pairs of n bars, from running sums; null where either is constant."""
    c = window_sum(f"{name}_pairs", n)
    mean = lambda term: window_sum(f"{name}_{term}", n) / F.when(c > 0, c)
    spread = (mean("aa") - mean("a") * mean("a")) * (mean("bb") - mean("b") * mean("b"))
    return (mean("ab") - mean("a") * mean("b")) / F.when(spread > 1e-24, F.sqrt(F.when(spread > 1e-24, spread)))


def _pairs(name: str, x: str, prior: str) -> dict[str, Column]:
    both = F.col(x).isNotNull() & F.col(prior).isNotNull()
    a, b = F.when(both, F.col(x)).otherwise(0.0), F.when(both, F.col(prior)).otherwise(0.0)
    return {f"{name}_pairs": F.when(both, 1).otherwise(0), f"{name}_a": a, f"{name}_b": b, f"{name}_aa": a * a, f"{name}_bb": b * b, f"{name}_ab": a * b}


def prepare_generic(bars: DataFrame) -> DataFrame:
    """What the generic descriptors need beyond prepare(): lags, sign changes, ordinal patterns of three closes."""
    bars = bars.withColumns({"r1": F.lag("r").over(series()), "v1": F.lag("volume").over(series()), "c1": F.lag("close", 1).over(series()), "c2": F.lag("close", 2).over(series())})
    flip = F.when(F.signum("r") != F.signum("r1"), 1.0).when(F.col("r1").isNotNull(), 0.0)
    code = lambda a, b: F.when(F.col(a) <= F.col(b), 1).otherwise(0)
    pattern = F.when(F.col("c2").isNotNull(), 4 * code("c2", "c1") + 2 * code("c1", "close") + code("c2", "close"))
    bars = bars.withColumns({"flip": flip, "pattern": pattern})
    r = F.coalesce("r", F.lit(0.0))
    return running(bars, **{f"pattern{p}": F.when(F.col("pattern") == p, 1).otherwise(0) for p in range(8)}, **_pairs("rr", "r", "r1"), **_pairs("vv", "volume", "v1"), r=r, r2=r * r, r3=r * r * r, r4=r * r * r * r, r_n=F.when(F.col("r").isNotNull(), 1).otherwise(0), flip=F.coalesce("flip", F.lit(0.0)))


def generic(lookbacks=GENERIC_LOOKBACKS) -> dict[str, Column]:
    out = {}
    for n in lookbacks:
        w = trailing(n - 2)
        c = window_sum("r_n", n - 1)
        m1, m2, m3, m4 = (window_sum(k, n - 1) / F.when(c > 0, c) for k in ("r", "r2", "r3", "r4"))
        var = m2 - m1 * m1
        var = F.when(var > 1e-18, var)
        out[f"ret_autocorr1_{n}"] = _r(full(_lag_correlation("rr", n - 2), n))
        out[f"vol_autocorr1_{n}"] = _r(full(_lag_correlation("vv", n - 1), n))
        out[f"ret_skew_{n}"] = _r(full((m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / (var * F.sqrt(var)), n))
        out[f"ret_kurt_{n}"] = _r(full((m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / (var * var) - 3, n))
        out[f"zero_cross_{n}"] = _r(full(F.when(var.isNotNull(), window_sum("flip", n - 2) / (n - 2)), n))
        shares = [window_sum(f"pattern{p}", n - 2) / F.lit(n - 2) for p in range(8)]
        entropy = sum((F.when(s > 0, -s * F.log(s)).otherwise(0.0) for s in shares[1:]), F.when(shares[0] > 0, -shares[0] * F.log(shares[0])).otherwise(0.0))
        out[f"perm_entropy_{n}"] = _r(full(entropy / F.log(F.lit(6.0)), n))
        spread = _cumulated_range(F.collect_list("run_r").over(w), m1)
        sd = F.sqrt(var)
        out[f"hurst_{n}"] = _r(full(F.when(spread > 1e-12, F.log(spread / sd) / F.log(F.lit(float(n - 1)))), n))
    return out


def forward_extremes(horizon: int) -> dict[str, Column]:
    """Best and worst close of the next bars against the entry close; the last bars see what there is."""
    ahead = series().rowsBetween(1, horizon)
    return {"mfe": F.max("close").over(ahead) / F.col("close") - 1, "mae": F.min("close").over(ahead) / F.col("close") - 1}


def benchmark_posture() -> dict[str, Column]:
    """Benchmark against its averages, its 252-day high and its realised volatility (one series, ordered by date)."""
    return {
        "vs_sma50": _r(safe_div(F.col("close"), sma("close", 50)) - 1), "vs_sma200": _r(safe_div(F.col("close"), sma("close", 200)) - 1),
        "dist_high_252": full(safe_div(F.col("close"), F.max("close").over(trailing(251))) - 1, 252),
        "vol_21": _r(full(F.stddev_samp("r").over(trailing(20)), 22)),
    }


