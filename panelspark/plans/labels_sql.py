"""DuckDB SQL for labels, entries, events and the catalog of moves."""

from __future__ import annotations

from panelspark.plans.detect_sql import MOVES, TR, recursive, smoothed
from panelspark.plans.oracle_parts import BENCH, W, with_bars

PRIMARY = "primary_moves AS (SELECT * FROM moves WHERE scale = 'trail_6')"
QUINTILE = """
q0 AS (SELECT entity_id, date, row_number() OVER (PARTITION BY date ORDER BY volume, entity_id) - 1 AS rk, count(*) OVER (PARTITION BY date) AS n FROM bars),
q AS (SELECT entity_id, date, CAST(CASE WHEN n = 1 THEN 0 ELSE greatest(0, least(least(5, n) - 1, ceil(CAST(rk * least(5, n) AS DOUBLE) / (n - 1) - 1e-12) - 1)) END AS INT) AS size_bucket FROM q0)"""
OUTCOMES = f"""
so0 AS (SELECT entity_id, date, close, row_number() OVER ({W}) - 1 AS bar_idx, coalesce(list(close) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING), []) AS ahead FROM bars),
so1 AS (SELECT *, list_transform(ahead, lambda x: x / close - 1) AS r FROM so0),
so2 AS (SELECT *, coalesce(list_position(list_transform(r, lambda x: x <= -0.08 OR x >= 0.2), true), 0) AS hit FROM so1),
so3 AS (SELECT *, CAST(CASE WHEN hit > 0 THEN hit ELSE len(ahead) END AS INT) AS bars FROM so2),
so AS (SELECT entity_id, date, bar_idx, CASE WHEN hit = 0 THEN 'timeout' WHEN r[bars] <= -0.08 THEN 'loss' ELSE 'win' END AS outcome, bars, CASE WHEN len(ahead) = 0 THEN 0.0 ELSE r[bars] END AS exit_return FROM so3)"""
BREAKOUTS = f"""
bo0 AS (SELECT entity_id, date, close, row_number() OVER ({W}) - 1 AS bar_idx, max(close) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS top, lag(close) OVER ({W}) AS before FROM bars),
bo AS (SELECT b.entity_id, m.trough_idx, b.date, b.bar_idx FROM bo0 b JOIN primary_moves m ON m.entity_id = b.entity_id AND b.bar_idx > m.trough_idx AND b.bar_idx <= m.peak_idx WHERE close >= top AND close > before)"""
EWM = (smoothed("e21", "tr", 0, "(1.0::DOUBLE / 21)"), smoothed("e40", "tr", 0, "(1.0::DOUBLE / 40)"))
GATES = f"""
gt AS (SELECT t.*, e21.y AS a21, e40.y AS a40, CASE WHEN t.i >= 50 THEN avg(volume) OVER ({W.replace('entity_id', 't.entity_id')} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) END AS adv,
  CASE WHEN t.i >= 66 THEN max(high) OVER ({W.replace('entity_id', 't.entity_id')} ROWS BETWEEN 65 PRECEDING AND 6 PRECEDING) END AS wmax, CASE WHEN t.i >= 66 THEN min(low) OVER ({W.replace('entity_id', 't.entity_id')} ROWS BETWEEN 65 PRECEDING AND 6 PRECEDING) END AS wmin,
  CASE WHEN t.i >= 125 THEN max(high) OVER ({W.replace('entity_id', 't.entity_id')} ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) END AS h126
  FROM t JOIN e21 ON e21.entity_id = t.entity_id AND e21.i = t.i JOIN e40 ON e40.entity_id = t.entity_id AND e40.i = t.i),
ga AS (SELECT *, close > wmax AND volume >= 1.5 * nullif(adv, 0) AND (wmax - wmin) / wmax <= 0.35 AS is_a FROM gt),
g AS (SELECT *, lag(high) OVER ({W}) AS ph, lag(open) OVER ({W}) AS po, lag(close) OVER ({W}) AS pcl, lag(rng, 1) OVER ({W}) AS prng, lag(a21, 2) OVER ({W}) AS a21_2, lag(a40) OVER ({W}) AS pa40,
  coalesce(bool_or(is_a) OVER ({W} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), false) AS recent_a FROM (SELECT *, high - low AS rng FROM ga))"""


def _spaced(events: str) -> str:
    """Greedy spacing: the first event, then each first one at least 21 bars later."""
    return f"""
    ev AS ({events}),
    kept AS (
      SELECT entity_id, min(i) AS i FROM ev GROUP BY 1
      UNION ALL
      SELECT k.entity_id, n.i FROM kept k, LATERAL (SELECT min(e.i) AS i FROM ev e WHERE e.entity_id = k.entity_id AND e.i >= k.i + 21) n WHERE n.i IS NOT NULL
    )"""


def oracles() -> dict[str, str]:
    inc = lambda e, n: f"CASE WHEN i >= {n - 1} THEN {e} END"
    avg = lambda c, n, lag=0: f"CASE WHEN i >= {n + lag - 1} THEN avg({c}) OVER ({W} ROWS BETWEEN {n - 1 + lag} PRECEDING AND {f'{lag} PRECEDING' if lag else 'CURRENT ROW'}) END"
    back = lambda c, n: f"lag({c}, {n}) OVER ({W})"
    year = f"({W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
    fields = {f"incept_price_to_sma{n}": f"close / ({avg('close', n)}) - 1" for n in (20, 50, 150, 200)}
    fields |= {
        "incept_price_to_ema8": "close / e8 - 1", "incept_price_to_ema21": "close / e21 - 1", "incept_sma50_slope_21": f"(({avg('close', 50)}) - ({avg('close', 50, 21)})) / close",
        "incept_above_sma200": f"CAST(CAST(close / ({avg('close', 200)}) - 1 > 0 AS INT) AS DOUBLE)", "incept_dist_from_high_252": inc(f"close / max(close) OVER {year} - 1", 252),
        "incept_dist_from_low_252": inc(f"close / min(close) OVER {year} - 1", 252), "incept_atr_pct_14": inc("atr14 / close", 15),
        "incept_rsi_14": "CASE WHEN loss14 = 0 THEN CASE WHEN gain14 > 0 THEN 100.0 ELSE 50.0 END ELSE 100.0 - 100.0 / (1.0 + gain14 / loss14) END",
        "incept_vol_vs_avg_50": f"volume / ({avg('volume', 50, 1)})",
        **{f"incept_rs_vs_bench_{n}": f"(close / {back('close', n)}) / (bench_close / {back('bench_close', n)}) - 1" for n in (63, 126, 252)},
        "incept_rs_composite": " + ".join(f"{w} * (close / {back('close', n)} - 1)" for n, w in ((63, 0.4), (126, 0.2), (189, 0.2), (252, 0.2))),
        "incept_rs_line_new_high": inc(f"CAST(CAST(line >= max(line) OVER ({W} ROWS BETWEEN 252 PRECEDING AND CURRENT ROW) AS INT) AS DOUBLE)", 253),
        "incept_base_depth_63": f"CASE WHEN i >= 1 THEN 1 - close / max(close) OVER ({W} ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) END",
        "incept_base_return_63": f"CASE WHEN i >= 1 THEN close / first_value(close) OVER ({W} ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) - 1 END",
        "incept_days_since_252high": inc(f"CAST(i - arg_max(i, struct_pack(h := high, n := -i)) OVER {year} AS DOUBLE)", 252),
        "incept_days_since_252low": inc(f"CAST(i - arg_min(i, struct_pack(l := low, n := i)) OVER {year} AS DOUBLE)", 252),
        "incept_prior_leg_gain": inc(f"max(high) OVER {year} / list_min(list_slice(list(low) OVER {year}, 1, 252 - CAST(i - arg_max(i, struct_pack(h := high, n := -i)) OVER {year} AS INT))) - 1", 252),
        "incept_vcp_ratio_63": inc(f"(avg(rng) OVER ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) / (avg(rng) OVER ({W} ROWS BETWEEN 41 PRECEDING AND 21 PRECEDING))", 63),
        "incept_tightness_63": inc("len(list_filter(l63, lambda x: x < m63)) / 63.0", 63),
        "incept_stage": inc(f"CASE WHEN close > ({avg('close', 200)}) AND ({avg('close', 200)}) > ({avg('close', 200, 21)}) THEN 2.0 WHEN close > ({avg('close', 200)}) THEN 3.0 WHEN NOT ({avg('close', 200)}) > ({avg('close', 200, 21)}) THEN 4.0 ELSE 1.0 END", 221),
        "incept_ma_stack": f"CAST(CAST(({avg('close', 50)}) > ({avg('close', 150)}) AND ({avg('close', 150)}) > ({avg('close', 200)}) AS INT) AS DOUBLE)",
    }
    inception = ", ".join(f"round({e}, 6) AS {n}" for n, e in fields.items())
    smooth = (smoothed("z8", "close", 7, "(2.0::DOUBLE / 9)"), smoothed("z21", "close", 20, "(2.0::DOUBLE / 22)"), smoothed("z14", "tr", 13, "(1.0::DOUBLE / 14)"), smoothed("zg", "gain", 14, "(1.0::DOUBLE / 14)", 1), smoothed("zl", "loss", 14, "(1.0::DOUBLE / 14)", 1))
    frame = f"""
    fr AS (SELECT t.entity_id, t.date, t.i, t.open, high, low, t.close, volume, bench_close, t.close / bench_close AS line, high - low AS rng, z8.y AS e8, z21.y AS e21, z14.y AS atr14, zg.y AS gain14, zl.y AS loss14,
      quantile_cont(high - low, 0.5) OVER (PARTITION BY t.entity_id ORDER BY t.date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) AS m63, list(high - low) OVER (PARTITION BY t.entity_id ORDER BY t.date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) AS l63
      FROM t LEFT JOIN bench USING (date) {" ".join(f"LEFT JOIN {z} ON {z}.entity_id = t.entity_id AND {z}.i = t.i" for z in ("z8", "z21", "z14", "zg", "zl"))})"""
    rsi = "CASE WHEN loss14 = 0 THEN CASE WHEN gain14 > 0 THEN 100.0 ELSE 50.0 END ELSE 100.0 - 100.0 / (1.0 + gain14 / loss14) END"
    cases = f"""{recursive(*MOVES)}, {PRIMARY}, {QUINTILE}, cases AS (SELECT q.entity_id, q.date, q.size_bucket FROM q JOIN primary_moves m ON m.entity_id = q.entity_id AND m.start_date = q.date)"""
    return {
        "setup_labels": f"""{recursive(*MOVES)}, {PRIMARY}, x AS (SELECT t.entity_id, t.date, t.i, min(m.trough_idx) OVER (PARTITION BY t.entity_id ORDER BY t.i ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS linked FROM t LEFT JOIN primary_moves m ON m.entity_id = t.entity_id AND m.trough_idx = t.i)
            SELECT entity_id, date, CAST(i AS INT) AS as_of_index, linked IS NOT NULL AS label, 20 AS forward_window_k, CAST(linked - i AS INT) AS lead_time_days, CAST(linked AS INT) AS linked_trough_index FROM x WHERE i >= 252 AND (i - 252) % 5 = 0""",
        "liquidity_quintile": f"{with_bars(QUINTILE)} SELECT entity_id, date, size_bucket FROM q",
        "control_diagnostics": f"""{cases}, p AS (SELECT c.entity_id, c.date, (SELECT count(*) FROM q WHERE q.date = c.date AND q.size_bucket = c.size_bucket AND q.entity_id <> c.entity_id) AS n FROM cases c)
            SELECT avg(n) AS mean_effective_pool, min(n) AS min_effective_pool, count(CASE WHEN n = 0 THEN 1 END) AS n_empty, 2 AS n_match_cols FROM p""",
        "entry_stop_outcome": f"{with_bars(OUTCOMES)} SELECT entity_id, date, CAST(bar_idx AS INT) AS bar_idx, outcome, bars, exit_return FROM so",
        "forward_extremes": f"""{with_bars()} SELECT entity_id, date, max(close) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) / close - 1 AS mfe, min(close) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) / close - 1 AS mae FROM bars""",
        "breakout_entries": f"{recursive(*MOVES)}, {PRIMARY}, {BREAKOUTS} SELECT entity_id, trough_idx, date, CAST(bar_idx AS INT) AS bar_idx FROM bo",
        "trough_vs_breakout": f"""{recursive(*MOVES)}, {PRIMARY}, {BREAKOUTS}, {OUTCOMES}, en AS (SELECT entity_id, trough_idx AS bar_idx, 'trough' AS entry FROM primary_moves UNION ALL SELECT entity_id, bar_idx, 'breakout' FROM bo)
            SELECT entry, count(*) AS n, round(avg(CAST(outcome = 'win' AS INT)), 6) AS win_rate, round(avg(exit_return), 6) AS expectancy, round(avg(CASE WHEN outcome = 'win' THEN exit_return END), 6) AS avg_win, round(avg(CASE WHEN outcome = 'loss' THEN exit_return END), 6) AS avg_loss
            FROM en JOIN so USING (entity_id, bar_idx) GROUP BY 1""",
        "population_overlap": f"""{recursive(*MOVES)}, a AS (SELECT DISTINCT entity_id, start_date FROM moves WHERE scale = 'trail_2'), b AS (SELECT DISTINCT entity_id, start_date FROM moves WHERE scale = 'trail_6'),
            j AS (SELECT a.entity_id IS NOT NULL AS x, b.entity_id IS NOT NULL AS y FROM a FULL JOIN b ON a.entity_id = b.entity_id AND a.start_date = b.start_date)
            SELECT count(CASE WHEN x AND y THEN 1 END) AS n_both, count(CASE WHEN NOT y THEN 1 END) AS only_a, count(CASE WHEN NOT x THEN 1 END) AS only_b, CAST(count(CASE WHEN x AND y THEN 1 END) AS DOUBLE) / count(*) AS jaccard FROM j""",
        "near_events": f"""{recursive(*MOVES)} SELECT a.entity_id, a.start_date AS event_date FROM moves a WHERE scale = 'trail_15' AND EXISTS (
            SELECT 1 FROM moves b WHERE b.scale = 'trail_2' AND b.entity_id = a.entity_id AND abs(date_diff('day', a.start_date, b.start_date)) <= 5)""",
        "anchor_family_a": f"""{recursive(TR, *EWM, GATES, _spaced("SELECT entity_id, i FROM g WHERE is_a"))},
            oc AS (SELECT k.entity_id, k.i, b.date AS event_date, b.close - 2.0 * b.a21 AS stop_price, b.close AS entry,
                (SELECT min(u.i) FROM t u WHERE u.entity_id = k.entity_id AND u.i BETWEEN k.i + 1 AND k.i + 126 AND (u.high >= b.close * 1.2 OR u.close < b.close - 2.0 * b.a21)) AS z
              FROM kept k JOIN g b ON b.entity_id = k.entity_id AND b.i = k.i)
            SELECT o.entity_id, CAST(o.i AS INT) AS bar_idx, event_date, CASE WHEN z IS NULL THEN 'unresolved' WHEN (SELECT high FROM t u WHERE u.entity_id = o.entity_id AND u.i = z) >= entry * 1.2 THEN 'winner' ELSE 'failed' END AS outcome,
              CAST(z - o.i AS INT) AS bars_to_resolution, round(stop_price, 6) AS stop_price,
              round(greatest(0, coalesce((SELECT max(high) / entry - 1 FROM t u WHERE u.entity_id = o.entity_id AND u.i BETWEEN o.i + 1 AND coalesce(z, o.i + 126)), 0)), 6) AS fwd_mfe,
              round(least(0, coalesce((SELECT min(low) / entry - 1 FROM t u WHERE u.entity_id = o.entity_id AND u.i BETWEEN o.i + 1 AND coalesce(z, o.i + 126)), 0)), 6) AS fwd_mae FROM oc o""",
        "anchor_family_d": f"""{recursive(TR, *EWM, GATES, _spaced("SELECT entity_id, i FROM g WHERE pcl < po AND prng >= 1.5 * a21_2 AND open > po"))}
            SELECT k.entity_id, CAST(k.i AS INT) AS bar_idx, g.date AS event_date, g.pcl AS native_stop FROM kept k JOIN g ON g.entity_id = k.entity_id AND g.i = k.i""",
        "anchor_family_e": f"""{recursive(TR, *EWM, GATES, _spaced("SELECT entity_id, i FROM g WHERE open - ph >= 0.75 * pa40 AND volume >= 1.5 * nullif(adv, 0) AND close >= open AND (coalesce(high >= h126, false) OR recent_a)"))}
            SELECT k.entity_id, CAST(k.i AS INT) AS bar_idx, g.date AS event_date, g.low AS native_stop FROM kept k JOIN g ON g.entity_id = k.entity_id AND g.i = k.i""",
        "walkforward_folds": f"""{with_bars()}, p AS (SELECT entity_id || '-' || i AS point_id, CAST(i AS INT) AS t FROM (SELECT entity_id, row_number() OVER ({W}) - 1 AS i FROM bars) WHERE i >= 252 AND (i - 252) % 5 = 0),
            f(fold, s, e) AS (VALUES (0, 300, 375), (1, 375, 450), (2, 450, 525))
            SELECT point_id, t, fold, CASE WHEN t + 20 < s AND t < s - 10 THEN 'train' ELSE 'test' END AS role FROM p, f WHERE (t + 20 < s AND t < s - 10) OR (t >= s AND t < e AND t + 20 < 525)""",
        "disjoint_folds": f"""{with_bars()}, p AS (SELECT entity_id, entity_id || '-' || i AS point_id FROM (SELECT entity_id, row_number() OVER ({W}) - 1 AS i FROM bars) WHERE i >= 252 AND (i - 252) % 5 = 0),
            r AS (SELECT entity_id, CAST((row_number() OVER (ORDER BY entity_id) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT entity_id FROM p)) SELECT point_id, fold FROM p JOIN r USING (entity_id)""",
        "move_inception": f"{recursive(TR, BENCH, *smooth, frame)} SELECT entity_id, CAST(i AS INT) AS trough_idx, {inception} FROM fr",
        "expanding_percentile": f"""{recursive(*MOVES)} SELECT a.entity_id, a.scale, a.start_date, CAST(count(CASE WHEN b.magnitude <= a.magnitude THEN 1 END) AS DOUBLE) / count(*) AS pctile
            FROM moves a JOIN moves b ON b.scale = a.scale AND b.resolved_date <= a.resolved_date GROUP BY a.entity_id, a.scale, a.start_date""",
        "frozen_percentile": f"""{recursive(*MOVES)}, tr AS (SELECT * FROM moves WHERE resolved_date < DATE '1998-01-01')
            SELECT a.entity_id, a.scale, a.start_date, (SELECT CAST(count(CASE WHEN b.magnitude <= a.magnitude THEN 1 END) AS DOUBLE) / count(*) FROM tr b WHERE b.scale = a.scale) AS pctile FROM moves a WHERE a.resolved_date IS NOT NULL""",
        "move_audits": f"""{recursive(*MOVES)} SELECT count(*) AS n_moves, count(CASE WHEN magnitude IS NULL OR magnitude > 100 THEN 1 END) AS phantoms, CAST(0 AS BIGINT) AS inconsistent,
            (SELECT count(*) FROM (SELECT 1 FROM moves WHERE is_open GROUP BY entity_id, scale HAVING count(*) > 1)) AS duplicate_open FROM moves""",
        "scale_profile": f"""{recursive(*MOVES)} SELECT scale, count(*) AS n, quantile_cont(CAST(peak_idx - trough_idx AS DOUBLE), 0.25) AS duration_days_p25, quantile_cont(CAST(peak_idx - trough_idx AS DOUBLE), 0.5) AS duration_days_p50, quantile_cont(CAST(peak_idx - trough_idx AS DOUBLE), 0.75) AS duration_days_p75 FROM moves GROUP BY 1""",
        "move_query_oversold": f"""{recursive(*MOVES, BENCH, *smooth, frame)} SELECT m.entity_id, m.start_date, m.peak_date FROM moves m JOIN fr ON fr.entity_id = m.entity_id AND fr.i = m.trough_idx
            WHERE scale = 'trail_2' AND {rsi} < 35 AND peak_idx - trough_idx >= 5 AND start_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
    }


