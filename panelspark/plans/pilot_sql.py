"""DuckDB SQL for the pilot universe and the exhibits."""

from __future__ import annotations

from panelspark.plans.clean_sql import INTERVALS
from panelspark.plans.detect_sql import ATR21, MFE, MOVES, SWING, TR, recursive
from panelspark.plans.discovery_sql import LABELLED, SAMPLE
from panelspark.plans.oracle_parts import BENCH, DIMS, MEMBER, PREP, W, with_bars

#: The swing detector under names of its own, beside the other one.
SWINGS = SWING.replace("steps", "sw_steps").replace("last_step", "sw_last").replace("found", "sw_found")


def oracles() -> dict[str, str]:
    cells = f"WITH {DIMS}, c AS (SELECT region, is_delisted, count(*) AS n FROM dims GROUP BY 1, 2), f AS (SELECT *, least(n, CAST(floor((SELECT count(*) // 5 FROM dims) * n / sum(n) OVER ()) AS BIGINT)) AS t, row_number() OVER (ORDER BY n DESC, region DESC, is_delisted DESC) AS place FROM c)"
    capture = f"""
    dc0 AS (SELECT bars.*, bench_close AS b, bench_close / lag(bench_close, 21) OVER ({W}) - 1 AS br, close / lag(close, 21) OVER ({W}) - 1 AS cr, row_number() OVER ({W}) - 1 AS i FROM bars JOIN bench USING (date)),
    dc1 AS (SELECT *, CASE WHEN i >= 63 THEN min(br) OVER ({W} ROWS BETWEEN 42 PRECEDING AND CURRENT ROW) END AS worst FROM dc0),
    dc2 AS (SELECT a.entity_id, a.date, a.worst, (SELECT arg_min(x.cr, x.i) FROM dc0 x WHERE x.entity_id = a.entity_id AND x.i BETWEEN a.i - 42 AND a.i AND x.br = a.worst) AS cr FROM dc1 a)"""
    return {
        "pilot_allocation": f"{cells} SELECT region, is_delisted, n, CAST(CASE WHEN place = 1 THEN t + (SELECT count(*) // 5 FROM dims) - sum(t) OVER () ELSE t END AS BIGINT) AS take FROM f",
        "reverse_splits": f"{with_bars()}, a AS (SELECT entity_id, date, 1 / (CASE WHEN entity_id % 2 = 0 AND date < DATE '1998-01-01' THEN 0.5 ELSE 1.0 END) AS f FROM bars) SELECT DISTINCT entity_id FROM (SELECT entity_id, lag(f) OVER ({W}) / f AS q FROM a) WHERE q >= 1.5",
        "first_eligible_families": f"""{with_bars(MEMBER, INTERVALS)}, fe AS (SELECT entity_id, min(date) AS first_date FROM bars WHERE volume > 100 GROUP BY 1),
            m AS (SELECT f.entity_id, first_date, count(i.entity_id) AS n FROM fe f LEFT JOIN intervals i ON i.entity_id = f.entity_id AND i.from_date <= first_date AND (i.to_date IS NULL OR i.to_date >= first_date) GROUP BY 1, 2)
            SELECT entity_id, first_date, CASE WHEN n = 0 THEN 'none' WHEN entity_id % 3 = 0 THEN 'sp500' WHEN entity_id % 3 = 1 THEN 'sp400_600' ELSE 'russell_only' END AS family, CASE WHEN first_date < DATE '1990-01-01' THEN 'pre1990' WHEN first_date < DATE '2010-01-01' THEN '1990_2009' ELSE '2010_present' END AS era FROM m""",
        "base_symbols": "SELECT s_suppkey AS entity_id, 'S' || s_suppkey || CASE WHEN s_suppkey % 4 = 0 THEN 'Q' ELSE '' END AS base, s_suppkey % 4 = 0 AS bankrupt FROM supplier",
        "latest_bar": f"{with_bars()} SELECT entity_id, max(date) AS date, arg_max(close, date) AS close FROM bars GROUP BY 1",
        "rewind_auc": f"""{recursive(PREP, *MOVES, SAMPLE, LABELLED)}, ofs(o) AS (VALUES (0), (5), (21), (63)), k AS (SELECT ofs.o, CAST(lb.label AS INT) AS y, f.range_position_63 AS s FROM lb, ofs JOIN fm f ON f.entity_id = lb.entity_id AND f.i = lb.i - ofs.o WHERE f.range_position_63 IS NOT NULL),
            r AS (SELECT o, y, rank() OVER (PARTITION BY o ORDER BY s) + (count(*) OVER (PARTITION BY o, s) - 1) / 2.0 AS r FROM k)
            SELECT o AS "offset", round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0), 9) AS auc FROM r GROUP BY 1""",
        "detector_comparison": f"""{recursive(TR, ATR21, MFE, SWINGS)}, b AS (SELECT scale, magnitude FROM moves UNION ALL SELECT 'atr_swing', tb.close / ta.close - 1 FROM sw_found f JOIN t ta ON ta.entity_id = f.entity_id AND ta.i = a JOIN t tb ON tb.entity_id = f.entity_id AND tb.i = b)
            SELECT scale, count(*) AS n, round(quantile_cont(magnitude, 0.1), 6) AS p10, round(quantile_cont(magnitude, 0.5), 6) AS p50, round(quantile_cont(magnitude, 0.9), 6) AS p90, avg(CAST(magnitude < 0.1 AS INT)) AS share_small FROM b GROUP BY 1""",
        "downside_capture": f"{with_bars(BENCH, capture)} SELECT entity_id, date, round(CASE WHEN worst < 0 THEN cr / worst END, 6) AS downside_capture FROM dc2",
        "regime_collinearity": f"""{with_bars(PREP, SAMPLE)}, k AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x, dist_from_high_63 AS g FROM pts WHERE {f} IS NOT NULL AND dist_from_high_63 IS NOT NULL" for f in ("range_position_63", "vol_surge_21"))})
            SELECT * FROM (SELECT feature, round(covar_pop(x, g) / (stddev_pop(x) * stddev_pop(g)), 6) AS corr FROM k GROUP BY 1) WHERE abs(corr) >= 0.1""",
        "sql_functions": f"{recursive(*MOVES)} SELECT entity_id, trough_idx, peak_idx, resolved_idx FROM moves WHERE scale = 'trail_6'",
    }
