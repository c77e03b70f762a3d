"""DuckDB SQL for recursions and detectors: the state machines as recursive queries over the bar index."""

from __future__ import annotations

from panelspark.plans.oracle_parts import BARS, W


def recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join([BARS, *parts]) + " "


TR = f"""
t0 AS (SELECT *, row_number() OVER ({W}) - 1 AS i, lag(close) OVER ({W}) AS pc FROM bars),
t AS MATERIALIZED (SELECT *, greatest(high - low, abs(high - coalesce(pc, close)), abs(low - coalesce(pc, close))) AS tr,
             greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss FROM t0)"""


def smoothed(name: str, x: str, seed_to: int, weight: str, first: int = 0) -> str:
    """A recursion started with the mean of x over bars first .. seed_to."""
    return f"""
{name} AS (
  SELECT entity_id, CAST({seed_to} AS BIGINT) AS i, avg({x}) AS y FROM t WHERE i BETWEEN {first} AND {seed_to} GROUP BY entity_id HAVING count(*) = {seed_to - first + 1}
  UNION ALL
  SELECT t.entity_id, t.i, s.y + {weight} * (t.{x} - s.y) FROM {name} s JOIN t ON t.entity_id = s.entity_id AND t.i = s.i + 1
)"""


ATR21 = smoothed("atr21", "tr", 20, "(1.0::DOUBLE / 21)")

MFE = """
steps AS (
  SELECT t.entity_id, k.k, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS s_i, t.close AS s_c, CAST(0 AS BIGINT) AS p_i, t.close AS p_c,
         CAST(NULL AS BIGINT) AS m_start, CAST(NULL AS BIGINT) AS m_peak
  FROM t, (VALUES (2.0::DOUBLE), (6.0::DOUBLE), (15.0::DOUBLE)) k(k) WHERE t.i = 0
  UNION ALL
  SELECT entity_id, k, i,
         CASE WHEN up THEN s_i WHEN NOT risen THEN CASE WHEN c < s_c THEN i ELSE s_i END WHEN stop THEN i ELSE s_i END,
         CASE WHEN up THEN s_c WHEN NOT risen THEN CASE WHEN c < s_c THEN c ELSE s_c END WHEN stop THEN c ELSE s_c END,
         CASE WHEN up THEN i WHEN NOT risen THEN CASE WHEN c < s_c THEN i ELSE p_i END WHEN stop THEN i ELSE p_i END,
         CASE WHEN up THEN c WHEN NOT risen THEN CASE WHEN c < s_c THEN c ELSE p_c END WHEN stop THEN c ELSE p_c END,
         CASE WHEN NOT up AND risen AND stop AND p_i - s_i >= 1 THEN s_i END,
         CASE WHEN NOT up AND risen AND stop AND p_i - s_i >= 1 THEN p_i END
  FROM (
    SELECT s.entity_id, s.k, t.i, t.close AS c, s.s_i, s.s_c, s.p_i, s.p_c, s.p_c > s.s_c AS risen, t.close > s.p_c AS up,
           coalesce(t.close < s.p_c - s.k * a.y, false) AS stop
    FROM steps s JOIN t ON t.entity_id = s.entity_id AND t.i = s.i + 1 LEFT JOIN atr21 a ON a.entity_id = t.entity_id AND a.i = t.i
  )
), last_step AS (
  SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY entity_id, k ORDER BY i DESC) = 1
), found AS (
  SELECT entity_id, k, m_start AS a, m_peak AS b, i AS z FROM steps WHERE m_start IS NOT NULL
  UNION ALL
  SELECT entity_id, k, s_i, p_i, NULL FROM last_step WHERE p_c > s_c AND p_i - s_i >= 1
), moves AS (
  SELECT f.entity_id, 'trail_' || CAST(CAST(f.k AS INT) AS VARCHAR) AS scale, f.k AS trail_atr, 'up' AS direction,
         CAST(f.a AS INT) AS trough_idx, CAST(f.b AS INT) AS peak_idx, CAST(f.z AS INT) AS resolved_idx,
         ta.date AS start_date, tb.date AS peak_date, tz.date AS resolved_date, f.z IS NULL AS is_open, tb.close / ta.close - 1 AS magnitude
  FROM found f JOIN t ta ON ta.entity_id = f.entity_id AND ta.i = f.a JOIN t tb ON tb.entity_id = f.entity_id AND tb.i = f.b
  LEFT JOIN t tz ON tz.entity_id = f.entity_id AND tz.i = f.z
)"""
MOVES = (TR, ATR21, MFE)

SWING = """
steps AS (
  SELECT t.entity_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS l_i, t.close AS l_c, CAST(NULL AS DOUBLE) AS l_a, CAST(-1 AS BIGINT) AS p_i, CAST(NULL AS DOUBLE) AS p_c,
         CAST(NULL AS BIGINT) AS m_low, CAST(NULL AS BIGINT) AS m_peak
  FROM t WHERE t.i = 0
  UNION ALL
  SELECT entity_id, i,
         CASE WHEN p_i < 0 AND c < l_c THEN i WHEN p_i >= 0 AND fell THEN i ELSE l_i END,
         CASE WHEN p_i < 0 AND c < l_c THEN c WHEN p_i >= 0 AND fell THEN c ELSE l_c END,
         CASE WHEN p_i < 0 AND c < l_c THEN a WHEN p_i >= 0 AND fell THEN a ELSE l_a END,
         CASE WHEN p_i < 0 THEN CASE WHEN c >= l_c AND confirmed THEN top_i ELSE -1 END WHEN c > p_c THEN i WHEN fell THEN -1 ELSE p_i END,
         CASE WHEN p_i < 0 THEN CASE WHEN c >= l_c AND confirmed THEN top_c END WHEN c > p_c THEN c WHEN fell THEN NULL ELSE p_c END,
         CASE WHEN p_i >= 0 AND fell AND p_i - l_i >= 10 THEN l_i END,
         CASE WHEN p_i >= 0 AND fell AND p_i - l_i >= 10 THEN p_i END
  FROM (
    SELECT s.entity_id, t.i, t.close AS c, a.y AS a, s.l_i, s.l_c, s.l_a, s.p_i, s.p_c,
           coalesce(t.close - s.l_c >= 3.0 * s.l_a AND t.close / s.l_c - 1 >= 0.10, false) AS confirmed,
           coalesce(t.close <= s.p_c AND (s.p_c - t.close) / s.p_c >= 0.20, false) AS fell,
           m.top_i, m.top_c
    FROM steps s JOIN t ON t.entity_id = s.entity_id AND t.i = s.i + 1 LEFT JOIN atr21 a ON a.entity_id = t.entity_id AND a.i = t.i,
    LATERAL (SELECT arg_max(u.i, u.close) AS top_i, max(u.close) AS top_c FROM t u WHERE s.p_i < 0 AND u.entity_id = s.entity_id AND u.i BETWEEN s.l_i AND t.i) m
  )
), last_step AS (
  SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY i DESC) = 1
), found AS (
  SELECT entity_id, m_low AS a, m_peak AS b, i AS z FROM steps WHERE m_low IS NOT NULL
  UNION ALL SELECT entity_id, l_i, p_i, NULL FROM last_step WHERE p_i >= 0 AND p_i - l_i >= 10
)"""


def oracles() -> dict[str, str]:
    smooth = [
        smoothed("s1", "tr", 13, "(1.0::DOUBLE / 14)"), smoothed("s2", "tr", 20, "(1.0::DOUBLE / 21)"), smoothed("s3", "close", 7, "(2.0::DOUBLE / 9)"), smoothed("s4", "close", 20, "(2.0::DOUBLE / 22)"),
        smoothed("s5", "tr", 0, "(1.0::DOUBLE / 21)"), smoothed("s6", "close", 0, "(2.0::DOUBLE / 22)"), smoothed("s7", "gain", 14, "(1.0::DOUBLE / 14)", 1), smoothed("s8", "loss", 14, "(1.0::DOUBLE / 14)", 1),
    ]
    names = "wilder_atr_14 wilder_atr_21 ema_8 ema_21 ewm_atr_21 ewm_21".split()
    listed = ", ".join(f"round(s{k}.y, 8) AS {n}" for k, n in enumerate(names, 1))
    joined = " ".join(f"LEFT JOIN s{k} ON s{k}.entity_id = t.entity_id AND s{k}.i = t.i" for k in range(1, 9))
    rsi = "round(CASE WHEN s8.y = 0 THEN CASE WHEN s7.y > 0 THEN 100.0 ELSE 50.0 END ELSE 100.0 - 100.0 / (1.0 + s7.y / s8.y) END, 8) AS rsi_14"
    columns = "entity_id, scale, trail_atr, direction, trough_idx, peak_idx, resolved_idx, start_date, peak_date, resolved_date, is_open"
    path = """
    seg AS (
      SELECT m.entity_id, m.scale, m.start_date, m.trough_idx, m.peak_idx, u.i, u.close, u.dr, first_value(u.close) OVER w AS first_c,
             max(u.close) OVER (PARTITION BY m.entity_id, m.scale, m.start_date ORDER BY u.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top
      FROM moves m JOIN (SELECT entity_id, i, close, close - pc AS dr FROM t) u ON u.entity_id = m.entity_id AND u.i BETWEEN m.trough_idx AND m.peak_idx
      WINDOW w AS (PARTITION BY m.entity_id, m.scale, m.start_date ORDER BY u.i)
    )"""
    described = """
    SELECT entity_id, scale, start_date, round(max_by(close, i) / min_by(close, i) - 1, 6) AS magnitude, CAST(max(peak_idx - trough_idx) AS DOUBLE) AS duration_days,
           round(ln(max_by(close, i) / min_by(close, i)), 6) AS log_magnitude,
           round(greatest(0, (min_by(close, i) - min(close)) / min_by(close, i)), 6) AS mae, round(max((top - close) / top), 6) AS max_intra_drawdown,
           round((max_by(close, i) - min_by(close, i)) / sum(CASE WHEN i > trough_idx THEN abs(dr) END), 6) AS smoothness,
           round(avg(CASE WHEN i > trough_idx THEN CAST(dr > 0 AS INT) END), 6) AS up_day_share,
           CAST(count(CASE WHEN i > trough_idx AND abs(dr / (close - dr)) > 0.05 THEN 1 END) AS DOUBLE) AS big_day_count
    FROM seg GROUP BY entity_id, scale, start_date"""
    return {
        "smoothed_series": f"{recursive(TR, *smooth)} SELECT t.entity_id, t.date, {listed}, {rsi} FROM t {joined}",
        "moves_mfe_multiscale": f"{recursive(*MOVES)} SELECT {columns} FROM moves",
        "move_descriptors": f"{recursive(*MOVES, path)} {described}",
        "moves_atr_swing": f"""{recursive(TR, ATR21, SWING)}
            SELECT f.entity_id, CAST(a AS INT) AS trough_idx, CAST(b AS INT) AS peak_idx, CAST(z AS INT) AS resolved_idx, z IS NULL AS is_open, tb.close / ta.close - 1 AS trough_gain_pct
            FROM found f JOIN t ta ON ta.entity_id = f.entity_id AND ta.i = a JOIN t tb ON tb.entity_id = f.entity_id AND tb.i = b""",
        "move_query_top": f"""{recursive(*MOVES)},
            ma AS (SELECT entity_id, i, CASE WHEN i >= 199 THEN close / (avg(close) OVER ({W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)) - 1 END AS rel FROM t)
            SELECT m.entity_id, start_date, peak_date, scale, round(magnitude, 6) AS total_pct_gain FROM moves m JOIN ma ON ma.entity_id = m.entity_id AND ma.i = m.trough_idx
            WHERE scale = 'trail_6' AND rel > 0 AND magnitude >= 0.2 ORDER BY magnitude DESC, m.entity_id, start_date LIMIT 50""",
    }


