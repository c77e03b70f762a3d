"""DuckDB SQL for bars of events and for events on gapped bars."""

from __future__ import annotations

from panelspark.plans.detect_sql import TR
from panelspark.plans.labels_sql import EWM, GATES, _spaced
from panelspark.plans.oracle_parts import BARS

GAPPED = BARS.replace("bars AS (", "whole AS (") + """,
bars AS (
  SELECT entity_id, date, o2 AS open, greatest(high, o2) AS high, least(low, o2) AS low, close, volume
  FROM (SELECT *, open * (1 + (CAST(volume AS BIGINT) % 7 - 3) / 100.0) AS o2 FROM whole)
)"""


def _events(gate: str, stop: str) -> str:
    parts = ",".join([GAPPED, TR, *EWM, GATES, _spaced(f"SELECT entity_id, i FROM g WHERE {gate}")])
    return f"WITH RECURSIVE {parts} SELECT k.entity_id, CAST(k.i AS INT) AS bar_idx, g.date AS event_date, g.{stop} AS native_stop FROM kept k JOIN g ON g.entity_id = k.entity_id AND g.i = k.i"


def oracles() -> dict[str, str]:
    return {
        "stream_bars_batch": """SELECT user_id AS entity_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS window_end, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
            FROM events GROUP BY 1, 2, 3""",
        "sliding_bars": """WITH e AS (SELECT user_id, CAST(date_trunc('day', ts) - k * INTERVAL 1 DAY AS TIMESTAMP) AS window_start FROM events, (VALUES (0), (1)) v(k))
            SELECT window_start, count(*) AS n_bars, CAST(sum(n) AS DOUBLE) AS n_events FROM (SELECT window_start, user_id, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1""",
        "event_sessions": """WITH e AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
            s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM e) SELECT user_id AS entity_id, min(ts) AS session_start, CAST(count(*) AS DOUBLE) AS n_events FROM s GROUP BY user_id, sid""",
        "event_props": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS sum_k, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY 1",
        "anchor_family_d_gapped": _events("pcl < po AND prng >= 1.5 * a21_2 AND open > po", "pcl"),
        "anchor_family_e_gapped": _events("open - ph >= 0.75 * pa40 AND volume >= 1.5 * nullif(adv, 0) AND close >= open AND (coalesce(high >= h126, false) OR recent_a)", "low"),
    }
