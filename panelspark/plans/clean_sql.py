"""DuckDB SQL for cleaning, universe and panel aggregates."""

from __future__ import annotations

from panelspark.plans.oracle_parts import BENCH, DIMS, MEMBER, W, with_bars

INTERVALS = f"""
mi0 AS (SELECT entity_id, date, member, row_number() OVER ({W}) - row_number() OVER (PARTITION BY entity_id, member ORDER BY date) AS run FROM member_days),
mi1 AS (SELECT entity_id, run, min(date) AS from_date, max(date) AS end_date, count(*) AS n_bars FROM mi0 WHERE member GROUP BY 1, 2),
intervals AS (SELECT m.entity_id, from_date, CASE WHEN end_date < last_date THEN end_date END AS to_date, n_bars, end_date
              FROM mi1 m JOIN (SELECT entity_id, max(date) AS last_date FROM bars GROUP BY 1) l USING (entity_id))"""
SPANS = """
spans AS (SELECT entity_id, from_date, to_date FROM intervals WHERE entity_id % 3 = 0 AND n_bars >= 4)"""
MASK = """
masked AS (SELECT b.*, volume > 0 AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.entity_id = b.entity_id AND b.date >= s.from_date AND (s.to_date IS NULL OR b.date <= s.to_date)) AS tradeable FROM bars b)"""
ADJUSTED = """
adjusted AS (SELECT *, close / (CASE WHEN entity_id % 2 = 0 AND date < DATE '1998-01-01' THEN 0.5 ELSE 1.0 END) AS raw_close,
                    CASE WHEN entity_id % 2 = 0 AND date < DATE '1998-01-01' THEN 0.5 ELSE 1.0 END AS adj_factor FROM bars)"""


def oracles() -> dict[str, str]:
    base = (MEMBER, INTERVALS, SPANS, MASK)
    ff = lambda c: f"CASE WHEN NOT tradeable AND last_{c} IS NOT NULL THEN last_{c} ELSE {c} END AS {c}"
    last = lambda c: f"last_value(CASE WHEN tradeable THEN {c} END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_{c}"
    out = {
        "bars_daily": f"{with_bars()} SELECT entity_id, date, open, high, low, close, volume FROM bars",
        "bars_weekly": f"""{with_bars()} SELECT entity_id, CAST(date + CAST((5 - isodow(date) + 7) % 7 AS INT) AS DATE) AS week_end, arg_min(open, date) AS open, max(high) AS high,
            min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2""",
        "bench_close": f"{with_bars(BENCH)} SELECT date, bench_close FROM bench",
        "theme_composite": f"""{with_bars(DIMS)} SELECT sector, date, round(sum(w * v) / sum(w), 6) AS composite FROM (
            SELECT sector, date, 1 + entity_id % 3 AS w, 100 * close / first_value(close) OVER ({W}) AS v FROM bars JOIN dims USING (entity_id)) GROUP BY 1, 2""",
        "tradeable_mask": f"{with_bars(*base)} SELECT entity_id, date, tradeable FROM masked",
        "forward_fill": f"""{with_bars(*base)}, l AS (SELECT *, {last('close')}, {last('high')}, {last('low')} FROM masked)
            SELECT entity_id, date, tradeable, {ff('close')}, {ff('high')}, {ff('low')} FROM l""",
        "clean_bars": f"""{with_bars(*base, ADJUSTED)}, a AS (SELECT adjusted.*, m.tradeable AND raw_close >= 40 AS tradeable FROM adjusted JOIN (SELECT entity_id, date, tradeable FROM masked) m USING (entity_id, date) WHERE date < DATE '2001-01-01'),
            l AS (SELECT *, {last('open')}, {last('close')}, {last('high')}, {last('low')}, max(CAST(tradeable AS INT)) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM a)
            SELECT entity_id, date, {ff('open')}, {ff('close')}, {ff('high')}, {ff('low')}, volume FROM l WHERE seen = 1""",
        "contiguous_spans": f"""{with_bars()}, f AS (SELECT entity_id, date, close < open AS f, row_number() OVER ({W}) AS rn FROM bars),
            g AS (SELECT *, rn - row_number() OVER (PARTITION BY entity_id, f ORDER BY date) AS run FROM f)
            SELECT entity_id, min(date) AS from_date, max(date) AS to_date, count(*) AS n_bars FROM g WHERE f GROUP BY entity_id, run""",
        "membership_intervals": f"{with_bars(MEMBER, INTERVALS)} SELECT entity_id, from_date, to_date FROM intervals",
        "closed_intervals": f"""{with_bars(MEMBER, INTERVALS, DIMS)} SELECT i.entity_id, from_date, CASE WHEN to_date IS NULL AND is_delisted THEN last_quoted ELSE to_date END AS to_date
            FROM intervals i LEFT JOIN dims USING (entity_id) LEFT JOIN (SELECT entity_id, max(date) AS last_quoted FROM bars GROUP BY 1) USING (entity_id)""",
        "interval_membership": f"""{with_bars(MEMBER, INTERVALS)} SELECT b.entity_id, b.date, EXISTS (SELECT 1 FROM intervals s WHERE s.entity_id = b.entity_id AND b.date >= s.from_date AND (s.to_date IS NULL OR b.date <= s.to_date)) AS is_member FROM bars b""",
        "return_disagreement": f"""{with_bars()}, b2 AS (SELECT entity_id, date, close * (1 + CASE WHEN volume > 40 THEN 0.03 ELSE 0 END) AS cb FROM bars WHERE extract(day FROM date) <> 15),
            j AS (SELECT entity_id, date, close AS ca, cb, count(*) OVER (PARTITION BY entity_id) AS n FROM bars JOIN b2 USING (entity_id, date)),
            r AS (SELECT *, abs(ln(ca / lag(ca) OVER ({W})) - ln(cb / lag(cb) OVER ({W}))) > 0.02 AS apart, row_number() OVER ({W}) AS rn FROM j WHERE n >= 3),
            g AS (SELECT *, rn - row_number() OVER (PARTITION BY entity_id, coalesce(apart, false) ORDER BY date) AS run FROM r)
            SELECT entity_id, min(date) AS from_date, max(date) AS to_date, count(*) AS n_bars FROM g WHERE apart GROUP BY entity_id, run""",
        "data_quality_scan": f"""{with_bars(ADJUSTED)}, act AS (SELECT DISTINCT entity_id, min(date) OVER (PARTITION BY entity_id) AS date FROM bars WHERE entity_id % 4 = 0 AND date >= DATE '1998-01-01'),
            s AS (SELECT a.*, CASE WHEN act.entity_id IS NOT NULL THEN 1 END AS is_action FROM adjusted a LEFT JOIN act USING (entity_id, date)),
            f AS (SELECT *, ln(close / lag(close) OVER ({W})) AS ra, ln(raw_close / lag(raw_close) OVER ({W})) AS rr, coalesce(max(is_action) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0) = 1 AS near FROM s),
            k AS (SELECT entity_id, date, 'phantom' AS kind, close <= 0 AND raw_close > 0 AND volume > 0 AS f FROM f UNION ALL SELECT entity_id, date, 'explosion', close > 1000 AND close / raw_close > 20 FROM f
                  UNION ALL SELECT entity_id, date, 'splice', coalesce(abs(ra - rr) > 0.05, false) AND NOT near FROM f),
            g AS (SELECT *, row_number() OVER (PARTITION BY entity_id, kind ORDER BY date) - row_number() OVER (PARTITION BY entity_id, kind, f ORDER BY date) AS run FROM k)
            SELECT entity_id, kind, min(date) AS from_date, max(date) AS to_date, count(*) AS n_bars FROM g WHERE f GROUP BY entity_id, kind, run""",
        "eligibility": f"""{with_bars(*base)}, e AS (SELECT m.*, NOT k.tradeable AS excluded, row_number() OVER (PARTITION BY m.entity_id ORDER BY m.date) - 1 AS i,
              avg(m.volume) OVER (PARTITION BY m.entity_id ORDER BY m.date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS adv_50, CAST(sum(CAST(m.volume AS DECIMAL(12,0)) * CAST(m.close AS DECIMAL(16,4))) OVER (PARTITION BY m.entity_id ORDER BY m.date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS DOUBLE) / count(*) OVER (PARTITION BY m.entity_id ORDER BY m.date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS dollar_adv_50
              FROM member_days m JOIN (SELECT entity_id, date, tradeable FROM masked) k USING (entity_id, date))
            SELECT entity_id, date, member, excluded, close > 0 AND volume > 0 AS data_valid, close >= 40 AS price_ok, i >= 251 AS history_ok, round(adv_50, 6) AS adv_50, dollar_adv_50,
              date < DATE '2001-01-01' AND NOT excluded AND (member OR date < DATE '1996-06-01') AND close > 0 AND volume > 0 AND close >= 40 AND i >= 251 AS eligible FROM e""",
        "lockbox_drop": f"{with_bars()} SELECT entity_id, date, close FROM bars WHERE date < DATE '2001-01-01'",
        "adjustment_offenders": f"""{with_bars(ADJUSTED)}, x AS (SELECT entity_id, date, close, CASE WHEN entity_id % 5 = 0 AND date >= DATE '2001-06-01' THEN NULL ELSE adj_factor END AS adj_factor FROM adjusted)
            SELECT entity_id, count(CASE WHEN close IS NOT NULL AND adj_factor IS NULL THEN 1 END) AS n_unadjusted, max(date) AS last_bar, max(CASE WHEN adj_factor IS NOT NULL THEN date END) AS last_adjusted
            FROM x GROUP BY 1 HAVING n_unadjusted > 0 OR last_adjusted IS NULL OR date_diff('day', last_adjusted, last_bar) > 30""",
        "crosswalk": """WITH e AS (SELECT s_suppkey AS entity_id, 'S.' || s_suppkey AS symbol FROM supplier), t AS (SELECT c_custkey AS ticker_id, 'S-' || c_custkey AS symbol FROM customer WHERE c_acctbal > 0)
            SELECT entity_id, ticker_id, e.symbol FROM e JOIN t ON replace(e.symbol, '.', '-') = t.symbol""",
        "restatement": f"""{with_bars()} SELECT count(*) AS n_compared, avg(CAST(abs((open - close) / close) > 0.01 AS INT)) AS incidence FROM bars""",
        "knee_floor": f"""{with_bars()}, v AS (SELECT entity_id, avg(volume) AS adv FROM bars GROUP BY 1), r AS (SELECT log10(adv) AS y, row_number() OVER (ORDER BY adv) - 1 AS x FROM v),
            e AS (SELECT *, min(y) OVER () AS lo, max(y) OVER () AS hi, max(x) OVER () AS n FROM r)
            SELECT round(10 ** arg_max(y, struct_pack(g := round(abs(CAST(x AS DOUBLE) / n - (y - lo) / (hi - lo)), 9), x := -x)), 4) AS floor, count(*) AS n FROM e""",
        "true_range": f"""{with_bars()} SELECT entity_id, date, greatest(high - low, abs(high - coalesce(lag(close) OVER ({W}), close)), abs(low - coalesce(lag(close) OVER ({W}), close))) AS tr FROM bars""",
        "catalog_series_hash": f"{with_bars()} SELECT entity_id, substring(sha256(string_agg(CAST(date AS VARCHAR), '|' ORDER BY date)), 1, 32) AS series_hash FROM bars GROUP BY 1",
    }
    return out
