"""DuckDB SQL for the window features."""

from __future__ import annotations

from panelspark.functions.windows import GENERIC_LOOKBACKS, GROUP_LOOKBACKS, LOOKBACKS, MA_PERIODS
from panelspark.plans.oracle_parts import BENCH, DIMS, PREP, W, full, over, slope, with_bars


def _query(columns: dict[str, str], source: str = "prep", parts: tuple[str, ...] = (PREP,)) -> str:
    listed = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"{with_bars(*parts)} SELECT entity_id, date, {listed} FROM {source}"


def _distance() -> dict[str, str]:
    out = {}
    for n in LOOKBACKS:
        top, low = over("max(close)", n - 1), over("min(close)", n - 1)
        out[f"dist_from_high_{n}"] = full(f"close / nullif({top}, 0) - 1", n)
        out[f"dist_from_low_{n}"] = full(f"close / nullif({low}, 0) - 1", n)
        out[f"base_depth_{n}"] = full(f"({top} - {low}) / nullif({top}, 0)", n)
        out[f"range_position_{n}"] = full(f"(close - {low}) / nullif({top} - {low}, 0)", n)
    return out


def _volatility() -> dict[str, str]:
    out = {}
    for n in LOOKBACKS:
        h = n // 2
        out[f"ret_std_{n}"] = f"round({full(over('stddev_samp(r)', n - 2), n)}, 6)"
        out[f"atr_pct_{n}"] = f"round({full(over('avg(tr)', n - 1) + ' / close', n + 1)}, 6)"
        out[f"vol_contraction_{n}"] = f"round({full(over('avg(tr)', h - 1) + ' / nullif(' + over('avg(tr)', 2 * h - 1, h) + ', 0)', 2 * h + 1)}, 6)"
    a, b = LOOKBACKS[0], LOOKBACKS[-1]
    out["range_tightness"] = f"round({full(over('avg(tr)', a - 1) + ' / nullif(' + over('avg(tr)', b - 1) + ', 0)', b + 1)}, 6)"
    return out


def _volume() -> dict[str, str]:
    out = {}
    up, down = "CASE WHEN dr > 0 THEN volume END", "CASE WHEN dr < 0 THEN volume END"
    for n in LOOKBACKS:
        mean, s = over("avg(volume)", n - 1), lambda e, n=n: over(f"sum({e})", n - 1)
        out[f"vol_ratio_{n}"] = full(f'{mean} / nullif({over("avg(volume)", 2 * n - 1, n)}, 0)', 2 * n)
        out[f"vol_surge_{n}"] = full(f'volume / nullif({mean}, 0)', n)
        out[f"vol_trend_{n}"] = full(f'{slope("volume", n)} / nullif({mean}, 0)', n)
        out[f"updown_vol_{n}"] = full(f'coalesce({s(up)}, 0) / nullif(coalesce({s(down)}, 0), 0)', n + 1)
        out[f"accum_vol_share_{n}"] = full(f'coalesce({s(up)}, 0) / nullif({s("volume")}, 0)', n + 1)
        out[f"up_vs_down_vol_extreme_{n}"] = full(f'{over(f"max({up})", n - 1)} / nullif({over(f"max({down})", n - 1)}, 0)', n + 1)
        out[f"cmf_{n}"] = f"round({full(f'{s("clv * volume")} / nullif({s("volume")}, 0)', n)}, 6)"
    return out


def _tightness() -> str:
    inner = ", ".join(f"{over('quantile_cont(rng, 0.5)', n - 1)} AS m{n}, {over('list(rng)', n - 1)} AS l{n}" for n in LOOKBACKS)
    outer = ", ".join(f"round({full(f'CASE WHEN m{n} > 0 THEN len(list_filter(l{n}, lambda x: x < m{n})) / CAST({n} AS DOUBLE) END', n)}, 6) AS tight_days_share_{n}" for n in LOOKBACKS)
    return f"{with_bars(PREP, f't AS (SELECT entity_id, date, i, {inner} FROM prep)')} SELECT entity_id, date, {outer} FROM t"


def _averages() -> dict[str, str]:
    m = {n: full(over("avg(close)", n - 1), n) for n in MA_PERIODS}
    out = {f"price_to_ma_{n}": f"round(close / nullif({x}, 0) - 1, 6)" for n, x in m.items()}
    every = ", ".join(m.values())
    out["ma_compression"] = f"round({full(f'(greatest({every}) - least({every})) / close', 50)}, 6)"
    return out


def _relative(lookbacks=LOOKBACKS) -> dict[str, str]:
    out = {}
    for n in lookbacks:
        back, line = f"lag(close, {n}) OVER ({W})", f"lag(bench_close, {n}) OVER ({W})"
        mean = f"(CAST({over('sum(rs)', n - 1)} AS DOUBLE) / {n})"
        whole = f"{over('count(rs)', n - 1)} = {n}"
        out[f"rel_strength_{n}"] = f"round((close / {back}) / (bench_close / {line}) - 1, 6)"
        out[f"rs_line_slope_{n}"] = f"round({full(f'CASE WHEN {whole} THEN {slope("rs", n)} / nullif(abs({mean}), 0) END', n)}, 6)"
        out[f"rs_at_high_{n}"] = f"round({full(f'CASE WHEN {whole} THEN (close / bench_close) / {over("max(close / bench_close)", n - 1)} END', n)}, 6)"
    return out


def _group() -> dict[str, str]:
    out = {}
    ratio = lambda a, b, n: f"round(({a} / lag({a}, {n}) OVER ({W})) / ({b} / lag({b}, {n}) OVER ({W})) - 1, 6)"
    for n in GROUP_LOOKBACKS:
        mean = f"(CAST({over('sum(rs)', n - 1)} AS DOUBLE) / {n})"
        out[f"sector_rs_{n}"] = ratio("close", "sector_close", n)
        out[f"sector_rs_slope_{n}"] = f"round({full(f'CASE WHEN {over("count(rs)", n - 1)} = {n} THEN {slope("rs", n)} / nullif(abs({mean}), 0) END', n)}, 6)"
        out[f"group_strength_{n}"] = ratio("sector_close", "bench_close", n)
    return out


def _correlation(a: str, b: str, before: int) -> str:
    both = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN"
    x, y = f"{both} {a} END", f"{both} {b} END"
    spread = f"({over(f'stddev_pop({x})', before)} * {over(f'stddev_pop({y})', before)})"
    return f"CASE WHEN {spread} > 1e-12 THEN {over(f'covar_pop({x}, {y})', before)} / {spread} END"


def _generic() -> str:
    out = {}
    for n in GENERIC_LOOKBACKS:
        moves = f"{over('stddev_pop(r)', n - 2)} > 1e-12"
        out[f"ret_autocorr1_{n}"] = f"round({full(_correlation('r', 'r1', n - 3), n)}, 6)"
        out[f"vol_autocorr1_{n}"] = f"round({full(_correlation('volume', 'v1', n - 2), n)}, 6)"
        m = lambda k, n=n: over(f"avg(r ** {k})", n - 2)
        var = f"({m(2)} - {m(1)} ** 2)"
        out[f"ret_skew_{n}"] = f"round({full(f'CASE WHEN {moves} THEN ({m(3)} - 3 * {m(1)} * {m(2)} + 2 * {m(1)} ** 3) / {var} ** 1.5 END', n)}, 6)"
        out[f"ret_kurt_{n}"] = f"round({full(f'CASE WHEN {moves} THEN {over("kurtosis_pop(r)", n - 2)} END', n)}, 6)"
        out[f"zero_cross_{n}"] = f"round({full(f'CASE WHEN {moves} THEN {over("avg(flip)", n - 3)} END', n)}, 6)"
        share = [f"({over(f'count(CASE WHEN pattern = {k} THEN 1 END)', n - 3)} / CAST({n - 2} AS DOUBLE))" for k in range(8)]
        entropy = " + ".join(f"CASE WHEN {s} > 0 THEN -{s} * ln({s}) ELSE 0 END" for s in share)
        out[f"perm_entropy_{n}"] = f"round({full(f'({entropy}) / ln(6)', n)}, 6)"
        out[f"hurst_{n}"] = f"round({full(f'CASE WHEN sd{n} > 1e-12 AND s{n} > 1e-12 THEN ln(s{n} / sd{n}) / ln({n - 1}) END', n)}, 6)"
    lists = ", ".join(f"{over('stddev_pop(r)', n - 2)} AS sd{n}, {over('avg(r)', n - 2)} AS mean{n}, {over('list(cum)', n - 2)} AS cums{n}" for n in GENERIC_LOOKBACKS)
    spread = ", ".join(f"list_max(list_transform(cums{n}, lambda x, k: x - k * mean{n})) - list_min(list_transform(cums{n}, lambda x, k: x - k * mean{n})) AS s{n}" for n in GENERIC_LOOKBACKS)
    parts = f"""
    g0 AS (SELECT *, lag(r) OVER ({W}) AS r1, lag(volume) OVER ({W}) AS v1, lag(close, 1) OVER ({W}) AS c1, lag(close, 2) OVER ({W}) AS c2,
                  coalesce(sum(r) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS cum FROM prep),
    g1 AS (SELECT *, CASE WHEN r1 IS NOT NULL THEN CASE WHEN sign(r) <> sign(r1) THEN 1.0 ELSE 0.0 END END AS flip,
                  CASE WHEN c2 IS NOT NULL THEN 4 * CAST(c2 <= c1 AS INT) + 2 * CAST(c1 <= close AS INT) + CAST(c2 <= close AS INT) END AS pattern, {lists} FROM g0),
    g AS (SELECT *, {spread} FROM g1)"""
    return _query(out, "g", (PREP, parts))


def oracles() -> dict[str, str]:
    priced = """rb AS (SELECT prep.*, bench_close, CAST(close / bench_close AS DECIMAL(18,9)) AS rs FROM prep LEFT JOIN bench USING (date))"""
    sectors = """
    sec AS (SELECT sector, date, CAST(sum(CAST(close AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS sector_close FROM bars JOIN dims USING (entity_id) GROUP BY 1, 2),
    gs AS (SELECT prep.*, bench_close, sector_close, CAST(close / sector_close AS DECIMAL(18,9)) AS rs
           FROM prep JOIN dims USING (entity_id) LEFT JOIN sec USING (sector, date) LEFT JOIN bench USING (date))"""
    posture = {
        "vs_sma50": f"round(close / nullif({full(over('avg(close)', 49), 50)}, 0) - 1, 6)", "vs_sma200": f"round(close / nullif({full(over('avg(close)', 199), 200)}, 0) - 1, 6)",
        "dist_high_252": full(f"close / nullif({over('max(close)', 251)}, 0) - 1", 252), "vol_21": f"round({full(over('stddev_samp(r)', 20), 22)}, 6)",
    }
    listed = ", ".join(f"{sql} AS {name}" for name, sql in posture.items())
    index = f"""
    b AS (SELECT 0 AS entity_id, date, bench_close AS close FROM bench),
    b0 AS (SELECT *, row_number() OVER ({W}) - 1 AS i, lag(close) OVER ({W}) AS pc FROM b),
    b1 AS (SELECT *, CASE WHEN pc > 0 AND close > 0 THEN ln(close / pc) END AS r FROM b0)"""
    tight = ", ".join(f"{over('quantile_cont(rng, 0.5)', n - 1)} AS m{n}, {over('list(rng)', n - 1)} AS l{n}" for n in LOOKBACKS)
    marked = f"mk AS (SELECT *, {tight} FROM rb)"
    shares = {f"tight_days_share_{n}": f"round({full(f'CASE WHEN m{n} > 0 THEN len(list_filter(l{n}, lambda x: x < m{n})) / CAST({n} AS DOUBLE) END', n)}, 6)" for n in LOOKBACKS}
    every = _distance() | _volatility() | _volume() | shares | _averages() | _relative()
    columns = ", ".join(f"{e} AS {n}" for n, e in every.items())
    return {
        "feature_matrix_points": f"{with_bars(PREP, BENCH, priced, marked)}, fx AS (SELECT entity_id, i, {columns} FROM mk) SELECT entity_id || '-' || i AS point_id, entity_id, CAST(i AS INT) AS bar_idx, {', '.join(every)} FROM fx WHERE i >= 252 AND (i - 252) % 20 = 0",
        "features_distance": _query(_distance()),
        "features_volatility": _query(_volatility()),
        "features_volume": _query(_volume()),
        "features_tightness": _tightness(),
        "features_averages": _query(_averages()),
        "features_relative_strength": _query(_relative(), "rb", (PREP, BENCH, priced)),
        "features_group_strength": _query(_group(), "gs", (PREP, BENCH, DIMS, sectors)),
        "features_generic": _generic(),
        "benchmark_posture": f"{with_bars(BENCH, index)} SELECT date, {listed} FROM b1",
    }
