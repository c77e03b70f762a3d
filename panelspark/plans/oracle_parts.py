"""Pieces of DuckDB SQL that the checking queries share."""

from __future__ import annotations

BARS = """
d AS (
  SELECT l_suppkey AS entity_id, CAST(l_shipdate AS DATE) AS date, CAST(round(avg(l_discount) - 0.05, 6) AS DECIMAL(12,6)) AS r,
         max(l_tax) AS tx, min(l_tax) AS tn, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2
), c AS (
  SELECT *, round(100 * exp(CAST(sum(r) OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)), 4) AS close FROM d
), o AS (
  SELECT *, coalesce(lag(close) OVER (PARTITION BY entity_id ORDER BY date), 100.0) AS open FROM c
), bars AS (
  SELECT entity_id, date, open, greatest(open, close) * (1 + tx / 4) AS high, least(open, close) * (1 - tn / 4) AS low, close, volume FROM o
)"""
BENCH = """
bench AS (SELECT date, CAST(sum(CAST(close AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS bench_close FROM bars GROUP BY date)"""
DIMS = """
dims AS (
  SELECT s_suppkey AS entity_id, n_name AS nation, r_name AS region, n_regionkey AS sector, s_acctbal < 0 AS is_delisted
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
MEMBER = """
member_days AS (
  SELECT b.*, n.entity_id IS NOT NULL AS member FROM bars b
  LEFT JOIN (SELECT DISTINCT l_suppkey AS entity_id, CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_returnflag = 'N') n USING (entity_id, date)
)"""
W = "PARTITION BY entity_id ORDER BY date"


def over(call: str, before: int, to: int = 0) -> str:
    end = "CURRENT ROW" if to == 0 else f"{to} PRECEDING"
    return f"{call} OVER ({W} ROWS BETWEEN {before} PRECEDING AND {end})"


def full(expr: str, n: int) -> str:
    return f"CASE WHEN i >= {n - 1} THEN {expr} END"


PREP = f"""
p0 AS (SELECT *, row_number() OVER ({W}) - 1 AS i, lag(close) OVER ({W}) AS pc FROM bars),
prep AS (
  SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
         CASE WHEN pc > 0 AND close > 0 THEN ln(close / pc) END AS r, close - pc AS dr, high - low AS rng,
         CASE WHEN high - low > 0 THEN ((close - low) - (high - close)) / (high - low) ELSE 0.0 END AS clv
  FROM p0
)"""


def with_bars(*parts: str) -> str:
    return "WITH " + ",".join([BARS, *parts]) + " "


def slope(y: str, n: int) -> str:
    s = lambda e: over(f"sum({e})", n - 1)
    sx, sxx, sy, sxy = s("i"), s("i * i"), f"CAST({s(y)} AS DOUBLE)", f"CAST({s(f'{y} * i')} AS DOUBLE)"
    return f"(({n} * {sxy} - CAST({sx} AS DOUBLE) * {sy}) / CAST({n} * {sxx} - {sx} * {sx} AS DOUBLE))"
