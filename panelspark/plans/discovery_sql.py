"""DuckDB SQL for statistics, neutralisation, lifts, breadth, regimes and negative controls."""

from __future__ import annotations

from panelspark.plans.clean_sql import INTERVALS, MASK, SPANS
from panelspark.plans.detect_sql import MOVES, recursive
from panelspark.plans.oracle_parts import BENCH, DIMS, MEMBER, PREP, W, full, over, with_bars

FEATURES = ("dist_from_high_63", "range_position_63", "vol_surge_21", "updown_vol_21")
SWEEP = (5, 8, 10, 13, 21, 50, 100, 200)
_TOP, _LOW = over("max(close)", 62), over("min(close)", 62)
UPS, DOWNS = over("sum(CASE WHEN dr > 0 THEN volume END)", 20), over("sum(CASE WHEN dr < 0 THEN volume END)", 20)
SAMPLE = f"""
fm AS (SELECT entity_id, date, i, {full(f"close / nullif({_TOP}, 0) - 1", 63)} AS dist_from_high_63, {full(f"(close - {_LOW}) / nullif({_TOP} - {_LOW}, 0)", 63)} AS range_position_63,
  {full(f"volume / nullif({over('avg(volume)', 20)}, 0)", 21)} AS vol_surge_21, {full(f"coalesce({UPS}, 0) / nullif(coalesce({DOWNS}, 0), 0)", 22)} AS updown_vol_21,
  {over('avg(volume)', 49)} AS adv_50, lead(close, 20) OVER ({W}) / close - 1 AS fwd, extract(year FROM date) AS year FROM prep),
pts AS (SELECT *, entity_id || '-' || i AS point_id FROM fm WHERE i >= 252 AND (i - 252) % 5 = 0)"""
LABELLED = """
lb AS (SELECT p.*, EXISTS (SELECT 1 FROM moves m WHERE m.scale = 'trail_2' AND m.entity_id = p.entity_id AND m.trough_idx BETWEEN p.i AND p.i + 20) AS label FROM pts p)"""
LONG = "lg AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, entity_id, point_id, CAST(label AS INT) AS g, {f} AS x FROM lb WHERE {f} IS NOT NULL" for f in FEATURES) + ")"
CLUSTERED = """
pc AS (SELECT feature, entity_id, count(*) AS n, sum(g) AS sg, sum(x) AS sx, sum(g * x) AS sgx FROM lg GROUP BY 1, 2),
tt AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(sg) AS sg, sum(sx) AS sx, sum(sgx) AS sgx FROM pc GROUP BY 1),
bt AS (SELECT *, (n * sgx - sg * sx) / (n * sg - sg * sg) AS b1 FROM tt), be AS (SELECT *, (sx - b1 * sg) / n AS b0 FROM bt),
sc AS (SELECT pc.feature, sum((pc.sx - b0 * pc.n - b1 * pc.sg) ** 2) AS uu, sum((pc.sx - b0 * pc.n - b1 * pc.sg) * (pc.sgx - b0 * pc.sg - b1 * pc.sg)) AS uv, sum((pc.sgx - b0 * pc.sg - b1 * pc.sg) ** 2) AS vv FROM pc JOIN be ON be.feature = pc.feature GROUP BY 1),
cr AS (SELECT be.feature, n, k, b1 AS coef, sqrt((sg * sg * uu - 2 * sg * n * uv + n * n * vv) / ((n * sg - sg * sg) ** 2) * k / (k - 1.0) * (n - 1.0) / (n - 2.0)) AS se FROM be JOIN sc ON sc.feature = be.feature)"""
EFFECTS = """
rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS r, cume_dist() OVER (PARTITION BY feature, g ORDER BY x) AS cd FROM lg),
n2 AS (SELECT feature, sum(g) AS n1, sum(1 - g) AS n0, sum(CASE WHEN g = 1 THEN r END) AS r1, avg(CASE WHEN g = 1 THEN x END) AS m1, avg(CASE WHEN g = 0 THEN x END) AS m0, var_samp(CASE WHEN g = 1 THEN x END) AS v1, var_samp(CASE WHEN g = 0 THEN x END) AS v0 FROM rk GROUP BY 1),
ks AS (SELECT feature, max(abs(c1 / n1 - c0 / n0)) AS ks_stat FROM (SELECT feature, x, sum(max(0)) OVER () AS z, CAST(sum(sum(g)) OVER (PARTITION BY feature ORDER BY x) AS DOUBLE) AS c1, CAST(sum(sum(1 - g)) OVER (PARTITION BY feature ORDER BY x) AS DOUBLE) AS c0,
   CAST(sum(sum(g)) OVER (PARTITION BY feature) AS DOUBLE) AS n1, CAST(sum(sum(1 - g)) OVER (PARTITION BY feature) AS DOUBLE) AS n0 FROM lg GROUP BY feature, x) GROUP BY 1)"""
#: Fixed p-values for the multiple-testing queries: a rule over the parts, so both engines see the same numbers.
PVALUES = "tests AS (SELECT p_partkey AS test_id, 'f' || (p_partkey % 7) AS family, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE ((p_partkey * 7919) % 100003) / 100003.0 / (1 + 200 * CAST(p_partkey % 7 = 3 AS INT)) END AS pvalue FROM part)"


def oracles() -> dict[str, str]:
    labelled = (PREP, *MOVES, SAMPLE, LABELLED, LONG)
    sma = ", ".join(f"{full(over('avg(close)', n - 1), n)} AS ma{n}" for n in SWEEP)
    breadth = f"""
    br0 AS (SELECT *, {sma}, {full(over('max(close)', 251), 252)} AS top, {full(over('min(close)', 251), 252)} AS bottom FROM (SELECT *, row_number() OVER ({W}) - 1 AS i FROM bars)),
    br AS (SELECT date, {", ".join(f"CAST(count(CASE WHEN close > ma{n} THEN 1 END) AS DOUBLE) / nullif(count(ma{n}), 0) AS pct_above_sma{n}" for n in SWEEP)},
      count(CASE WHEN close >= top THEN 1 END) AS new_high, count(CASE WHEN close <= bottom THEN 1 END) AS new_low,
      CAST(count(CASE WHEN close >= top THEN 1 END) - count(CASE WHEN close <= bottom THEN 1 END) AS DOUBLE) / nullif(count(top), 0) AS net_new_high_pct FROM br0 GROUP BY date)"""
    rank = lambda c, part: f"(rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0)"
    bh = lambda p, extra="": f"row_number() OVER (PARTITION BY {extra}{p} IS NULL ORDER BY {p}) AS rk, count(*) OVER (PARTITION BY {extra}{p} IS NULL) AS m"
    elig = "el AS (SELECT entity_id, date FROM masked WHERE tradeable)"
    retention = f"""{with_bars(PREP, SAMPLE)}, k AS (SELECT * FROM fm WHERE range_position_63 IS NOT NULL AND vol_surge_21 IS NOT NULL), w AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, avg(range_position_63) OVER (PARTITION BY date) AS mf,
              avg(vol_surge_21) OVER (PARTITION BY date) AS mx, covar_pop(range_position_63, vol_surge_21) OVER (PARTITION BY date) AS cv, var_pop(vol_surge_21) OVER (PARTITION BY date) AS vx FROM k),
            z AS (SELECT 1 AS one, range_position_63 AS a, round(range_position_63 - mf - CASE WHEN n > 2 AND vx > 1e-18 THEN cv / vx ELSE 0 END * (vol_surge_21 - mx), 9) AS b, fwd AS t FROM w WHERE fwd IS NOT NULL),
            r AS (SELECT {rank('a', 'one')} AS ra, {rank('b', 'one')} AS rb, {rank('t', 'one')} AS rt FROM z), cx AS (SELECT abs(covar_pop(ra, rt) / (stddev_pop(ra) * stddev_pop(rt))) AS x, abs(covar_pop(rb, rt) / (stddev_pop(rb) * stddev_pop(rt))) AS y FROM r)
            SELECT round(x, 6) AS raw_ic, round(y, 6) AS residual_ic, round(y / x, 5) AS retention FROM cx"""
    return {
        "effect_retention": retention,
        "univariate_screen": f"""{recursive(*labelled, CLUSTERED, EFFECTS.replace("sum(max(0)) OVER () AS z, ", ""))}
            SELECT n2.feature, CAST(n1 AS BIGINT) AS n_setup, CAST(n0 AS BIGINT) AS n_control, round(coef, 6) AS coef, round(se, 6) AS se, round(coef / se, 5) AS t, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS cohens_d,
              round(1 - 2 * (r1 - n1 * (n1 + 1) / 2.0) / (CAST(n1 AS DOUBLE) * n0), 6) AS rank_biserial, round(ks_stat, 6) AS ks_stat FROM n2 JOIN ks USING (feature) JOIN cr USING (feature)""",
        "bh_fdr": f"""WITH {PVALUES}, r AS (SELECT *, {bh('pvalue')} FROM tests), q AS (SELECT *, CASE WHEN pvalue IS NOT NULL THEN least(1.0, min(pvalue * m / rk) OVER (PARTITION BY pvalue IS NULL ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS qv FROM r)
            SELECT test_id, round(qv, 9) AS qvalue, coalesce(qv <= 0.05, false) AS significant FROM q""",
        "hierarchical_fdr": f"""WITH {PVALUES}, s AS (SELECT family, min(pvalue * m / rk) AS fp FROM (SELECT *, {bh('pvalue', 'family, ')} FROM tests) WHERE pvalue IS NOT NULL GROUP BY 1),
            fr AS (SELECT *, row_number() OVER (ORDER BY fp) AS rk, count(*) OVER () AS m FROM s), fq AS (SELECT family, m, min(fp * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= 0.05 AS sel FROM fr),
            al AS (SELECT 0.05 * count(CASE WHEN sel THEN 1 END) / count(*) AS alpha FROM fq),
            mq AS (SELECT *, CASE WHEN pvalue IS NOT NULL THEN least(1.0, min(pvalue * m / rk) OVER (PARTITION BY family, pvalue IS NULL ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS q FROM (SELECT *, {bh('pvalue', 'family, ')} FROM tests))
            SELECT test_id, mq.family, sel AS family_significant, coalesce(sel AND q <= alpha, false) AS rejected FROM mq JOIN fq USING (family), al""",
        "ic_by_year": f"""{with_bars(PREP, SAMPLE)}, k AS (SELECT year, range_position_63 AS f, fwd AS t FROM pts WHERE range_position_63 IS NOT NULL AND fwd IS NOT NULL), r AS (SELECT year, {rank('f', 'year')} AS rf, {rank('t', 'year')} AS rt FROM k)
            SELECT CAST(year AS INT) AS year, count(*) AS n, round(covar_pop(rf, rt) / (stddev_pop(rf) * stddev_pop(rt)), 6) AS ic FROM r GROUP BY 1 HAVING count(*) >= 3""",
        "ic_decay": f"""{with_bars(PREP, SAMPLE)}, h(h) AS (VALUES (0), (5), (10), (20), (30)), k AS (SELECT h.h, f.range_position_63 AS f, p.fwd AS t FROM pts p, h JOIN fm f ON f.entity_id = p.entity_id AND f.i = p.i - h.h WHERE f.range_position_63 IS NOT NULL AND p.fwd IS NOT NULL),
            r AS (SELECT h, {rank('f', 'h')} AS rf, {rank('t', 'h')} AS rt FROM k) SELECT h AS horizon_days, count(*) AS n, round(covar_pop(rf, rt) / (stddev_pop(rf) * stddev_pop(rt)), 6) AS ic FROM r GROUP BY 1""",
        "factor_neutralize": f"""{with_bars(PREP, SAMPLE)}, k AS (SELECT * FROM fm WHERE range_position_63 IS NOT NULL AND vol_surge_21 IS NOT NULL), w AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, avg(range_position_63) OVER (PARTITION BY date) AS mf, avg(vol_surge_21) OVER (PARTITION BY date) AS mx,
              covar_pop(range_position_63, vol_surge_21) OVER (PARTITION BY date) AS cv, var_pop(vol_surge_21) OVER (PARTITION BY date) AS vx FROM k)
            SELECT entity_id, date, round(range_position_63 - mf - CASE WHEN n > 2 AND vx > 1e-18 THEN cv / vx ELSE 0 END * (vol_surge_21 - mx), 6) AS residual FROM w""",
        "industry_neutralize": f"""{with_bars(PREP, DIMS, SAMPLE)} SELECT entity_id, date, round(range_position_63 - avg(range_position_63) OVER (PARTITION BY date, sector), 6) AS residual FROM fm JOIN dims USING (entity_id) WHERE range_position_63 IS NOT NULL""",
        "correlation_pairs": f"""{with_bars(PREP, SAMPLE)}
            SELECT * FROM ({" UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr FROM pts" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:])}) WHERE abs(corr) >= 0.1""",
        "decile_lift": f"""{with_bars(PREP, SAMPLE)}, k AS (SELECT *, floor((row_number() OVER (ORDER BY range_position_63, point_id) - 1) * 10 / count(*) OVER ()) AS decile FROM pts WHERE range_position_63 IS NOT NULL AND fwd IS NOT NULL)
            SELECT CAST(decile AS INT) AS decile, round(avg(fwd), 6) AS mean, round(avg(CAST(fwd > 0 AS INT)), 6) AS hit_rate, count(*) AS n FROM k GROUP BY 1""",
        "decile_lift_by_date": f"""{with_bars(PREP, SAMPLE)}, k AS (SELECT *, count(*) OVER (PARTITION BY date) AS c FROM fm WHERE range_position_63 IS NOT NULL AND fwd IS NOT NULL),
            dd AS (SELECT *, floor((row_number() OVER (PARTITION BY date ORDER BY range_position_63, entity_id) - 1) * 10 / c) AS decile FROM k WHERE c >= 10), p AS (SELECT date, decile, avg(fwd) AS m, avg(CAST(fwd > 0 AS INT)) AS h, count(*) AS n FROM dd GROUP BY 1, 2)
            SELECT CAST(decile AS INT) AS decile, round(avg(m), 6) AS mean, round(avg(h), 6) AS hit_rate, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1""",
        "capacity": f"""{with_bars(PREP, SAMPLE)}, k AS (SELECT * FROM pts WHERE range_position_63 IS NOT NULL), t AS (SELECT * FROM k ORDER BY range_position_63 DESC, point_id DESC LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) FROM k))
            SELECT count(*) AS n_top, round(quantile_cont(adv_50, 0.5), 6) AS median_adv, round(quantile_cont(adv_50 * 0.01, 0.5), 6) AS median_clip, round(sum(adv_50 * 0.01), 4) AS aggregate_capacity FROM t""",
        "reliability": """WITH k AS (SELECT doc_id, quality, ((doc_id * 7919) % 1000) / 1000.0 AS p FROM labels) SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, round(avg(p), 9) AS mean_predicted, avg(CAST(quality AS DOUBLE)) AS frac_positive, count(*) AS n FROM k GROUP BY 1""",
        "auc_by_year": f"""{recursive(*labelled)}, k AS (SELECT year, CAST(label AS INT) AS y, {rank('range_position_63', 'year')} AS r FROM lb WHERE range_position_63 IS NOT NULL)
            SELECT CAST(year AS INT) AS year, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0), 9) AS auc FROM k GROUP BY 1""",
        "classify_findings": """WITH f AS (SELECT p_partkey AS finding_id, (p_partkey * 37 % 100) / 100.0 AS a, 0.4 + (p_partkey * 53 % 30) / 100.0 AS b, (p_partkey * 71 % 100) / 100.0 AS c, (p_partkey * 91 % 100) / 100.0 AS d, p_partkey % 3 > 0 AS e, p_partkey % 5 > 1 AS g FROM part)
            SELECT finding_id, CASE WHEN a >= 0.7 AND b >= 0.45 AND c >= 0.5 AND d >= 0.5 AND e AND g THEN 1 WHEN c >= 0.5 AND d >= 0.5 AND e THEN 2 ELSE 3 END AS tier FROM f""",
        "breadth": f"{with_bars(breadth)} SELECT *, pct_above_sma5 - pct_above_sma200 AS breadth_spread_5_200 FROM br",
        "market_context": f"""{with_bars(MEMBER, INTERVALS, SPANS, MASK)}, {elig}, x AS (SELECT *, row_number() OVER ({W}) AS rn, {over('avg(close)', 4)} AS s5, {over('avg(close)', 199)} AS s200 FROM bars)
            SELECT date, 100.0 * avg(CAST(close > s5 AS INT)) AS pct_above_5, 100.0 * avg(CAST(close > s200 AS INT)) AS pct_above_200, count(*) AS n FROM x JOIN el USING (entity_id, date) WHERE rn >= 200 GROUP BY 1""",
        "regime_daily": f"""{with_bars(BENCH, breadth)}, a AS (SELECT date, bench_close, CASE WHEN row_number() OVER (ORDER BY date) >= 200 THEN avg(bench_close) OVER (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS ma FROM bench), s AS (SELECT date, CASE WHEN ma IS NOT NULL THEN CAST(CAST(bench_close > ma AS INT) AS DOUBLE) END AS trend_anchor, net_new_high_pct AS f2 FROM a LEFT JOIN br USING (date)),
            z AS (SELECT *, CASE WHEN f2 IS NOT NULL THEN greatest(-10.0, least(10.0, f2 * 10)) END AS score FROM s)
            SELECT date, f2 AS f2_score, trend_anchor, score AS composite_score, CASE WHEN score <= -3 THEN 'risk_off' WHEN score <= 3 THEN 'neutral' WHEN score IS NOT NULL THEN 'risk_on' END AS regime_label, 'v1_breadth_anchor' AS score_version FROM z""",
        "era_normalize": f"""{with_bars(PREP, SAMPLE)} SELECT point_id, CASE WHEN range_position_63 IS NOT NULL THEN round(CASE WHEN stddev_pop(range_position_63) OVER (PARTITION BY year) > 0 THEN (range_position_63 - avg(range_position_63) OVER (PARTITION BY year)) / stddev_pop(range_position_63) OVER (PARTITION BY year) ELSE 0 END, 6) END AS range_position_63 FROM pts""",
        "shift_control": f"""{with_bars(PREP, SAMPLE)}, k AS (SELECT entity_id, i, fwd, row_number() OVER (PARTITION BY entity_id ORDER BY i) - 1 AS a, count(*) OVER (PARTITION BY entity_id) AS n FROM pts)
            SELECT x.entity_id, CAST(x.i AS INT) AS bar_idx, y.fwd AS rolled FROM k x JOIN k y ON y.entity_id = x.entity_id AND y.a = (x.a - 5 + 5 * x.n) % x.n""",
        "agreement": f"""{with_bars(PREP, SAMPLE)}, k AS (SELECT CAST(floor(4 * least(0.999, range_position_63)) AS INT) AS a, CAST(floor(least(3, vol_surge_21)) AS INT) AS b FROM pts WHERE range_position_63 IS NOT NULL AND vol_surge_21 IS NOT NULL), cc AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM k GROUP BY 1, 2),
            sa AS (SELECT sum(m * (m - 1) / 2) AS p, sum(m * ln(m)) AS h FROM (SELECT sum(n) AS m FROM cc GROUP BY a)), sb AS (SELECT sum(m * (m - 1) / 2) AS p, sum(m * ln(m)) AS h FROM (SELECT sum(n) AS m FROM cc GROUP BY b)), s AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS p, sum(n * ln(n)) AS h FROM cc)
            SELECT round((s.p - sa.p * sb.p / (s.n * (s.n - 1) / 2)) / ((sa.p + sb.p) / 2 - sa.p * sb.p / (s.n * (s.n - 1) / 2)), 6) AS ari, round(greatest(0, (sa.h + sb.h - 2 * s.h) / s.n), 6) AS variation_of_information FROM s, sa, sb""",
        "rs_vs_theme": f"""{with_bars(DIMS)}, v AS (SELECT entity_id, sector, date, close, 1 + entity_id % 3 AS w, 100 * close / first_value(close) OVER ({W}) AS v FROM bars JOIN dims USING (entity_id)), cm AS (SELECT sector, date, sum(w * v) / sum(w) AS composite FROM v GROUP BY 1, 2)
            SELECT entity_id, date, round((close / lag(close, 63) OVER ({W})) / (composite / lag(composite, 63) OVER ({W})) - 1, 6) AS rs_vs_theme FROM v JOIN cm USING (sector, date)""",
    }
