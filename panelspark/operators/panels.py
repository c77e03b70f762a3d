"""Aggregates over panels: weeks, themes, breadth, regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.functions.windows import full, safe_div
from panelspark.sources.bars import KEY, series, trailing

#: Averages that breadth sweeps over.
SWEEP = (5, 8, 10, 13, 21, 50, 100, 200)


def weekly(bars: DataFrame) -> DataFrame:
    """Weeks that end on Friday, labelled by it whether or not it traded; weeks without a bar do not exist."""
    week = F.next_day(F.date_sub("date", 1), "FRI").alias("week_end")
    return bars.groupBy(KEY, week).agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))


def theme_composite(bars: DataFrame, weights: DataFrame) -> DataFrame:
    """sector, date, composite: members rebased to 100 at their first bar, averaged by weight over those that trade."""
    rebased = bars.withColumn("value", F.lit(100.0) * F.col("close") / F.first("close").over(series().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rebased.join(weights, KEY)
    return rows.groupBy("sector", "date").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("composite"))


def rs_vs_theme(bars: DataFrame, composite: DataFrame, lookback: int = 63) -> DataFrame:
    """Return of each entity over its theme's return, minus 1."""
    rows = bars.join(composite, ["sector", "date"])
    own = F.col("close") / F.lag("close", lookback).over(series())
    theme = F.col("composite") / F.lag("composite", lookback).over(series())
    return rows.select(KEY, "date", (safe_div(own, theme) - 1).alias("rs_vs_theme"))


def breadth(bars: DataFrame, eligible: DataFrame | None = None, window: int = 252, sweep=SWEEP) -> DataFrame:
    """Per date: the share of entities above each average, among those whose average is defined; new highs and lows.

    With eligible (entity_id, date), only those cells are counted; windows still see every bar of an entity that is kept.
    """
    rows = bars if eligible is None else bars.join(eligible.select(KEY, "date"), [KEY, "date"], "left_semi")
    rows = rows.withColumn("i", F.row_number().over(series()) - 1)
    rows = rows.withColumns({f"ma{n}": full(F.avg("close").over(trailing(n - 1)), n) for n in sweep} | {"top": full(F.max("close").over(trailing(window - 1)), window), "bottom": full(F.min("close").over(trailing(window - 1)), window)})
    share = lambda n: safe_div(F.count_if(F.col("close") > F.col(f"ma{n}")).cast("double"), F.count(f"ma{n}"))
    high, low = F.count_if(F.col("close") >= F.col("top")), F.count_if(F.col("close") <= F.col("bottom"))
    out = rows.groupBy("date").agg(*(share(n).alias(f"pct_above_sma{n}") for n in sweep), high.alias("new_high"), low.alias("new_low"), safe_div((high - low).cast("double"), F.count("top")).alias("net_new_high_pct"))
    return out.withColumn(f"breadth_spread_{sweep[0]}_{sweep[-1]}", F.col(f"pct_above_sma{sweep[0]}") - F.col(f"pct_above_sma{sweep[-1]}"))


def market_context(bars: DataFrame, eligible: DataFrame) -> DataFrame:
    """Percent of eligible entities above their 5 and 200 bar averages, once 200 bars exist."""
    rows = bars.withColumns({"rn": F.row_number().over(series()), "s5": F.avg("close").over(trailing(4)), "s200": F.avg("close").over(trailing(199))}).where("rn >= 200")
    rows = rows.join(eligible.where("eligible").select(KEY, "date"), [KEY, "date"])
    pct = lambda c: F.lit(100.0) * F.avg((F.col("close") > F.col(c)).cast("int"))
    return rows.groupBy("date").agg(pct("s5").alias("pct_above_5"), pct("s200").alias("pct_above_200"), F.count("*").alias("n"))


def trend_anchor(line: DataFrame, period: int = 200) -> DataFrame:
    """1 above the average, 0 at or below it, null before it exists. One row a date: a single ordered pass."""
    order = Window.orderBy("date")
    mean = F.when(F.row_number().over(order) >= period, F.avg("bench_close").over(order.rowsBetween(-(period - 1), 0)))
    return line.withColumn("trend_anchor", F.when(mean.isNotNull(), (F.col("bench_close") > mean).cast("double")))


def regime_daily(bars: DataFrame, line: DataFrame, eligible: DataFrame | None, window: int = 252, require_eligible: bool = True) -> DataFrame:
    """date, f2_score, trend_anchor, composite_score, regime_label, score_version."""
    if require_eligible and eligible is None:
        raise ValueError("regimes need the eligibility of every date")
    rows = trend_anchor(line).join(breadth(bars, eligible, window).select("date", F.col("net_new_high_pct").alias("f2_score")), "date", "left")
    score = F.when(F.col("f2_score").isNotNull(), F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("f2_score") * 10.0)))
    label = F.when(score <= -3, "risk_off").when(score <= 3, "neutral").when(score.isNotNull(), "risk_on")
    return rows.select("date", "f2_score", "trend_anchor", score.alias("composite_score"), label.alias("regime_label"), F.lit("v1_breadth_anchor").alias("score_version"))


def era_normalize(df: DataFrame, columns: list[str], era: str = "era") -> DataFrame:
    """z-scores within each era with the population deviation; 0 where an era has none."""
    w = Window.partitionBy(era)
    z = lambda c: F.when(F.stddev_pop(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.when(F.stddev_pop(c).over(w) > 0, F.stddev_pop(c).over(w))).otherwise(0.0)
    return df.withColumns({c: F.when(F.col(c).isNotNull(), z(c)) for c in columns})


def downside_capture(bars: DataFrame, window: int = 63, span: int = 21) -> DataFrame:
    """entity_id, date, downside_capture: over the benchmark's worst span within the window, the entity's return over the
    benchmark's; null if the benchmark never fell or a value is missing. Bars need bench_close."""
    b, c = F.col("bench_close"), F.col("close")
    rows = bars.withColumns({"b_ret": b / F.lag(b, span).over(series()) - 1, "c_ret": c / F.lag(c, span).over(series()) - 1, "i": F.row_number().over(series()) - 1})
    w = trailing(window - span)
    whole = F.count("b_ret").over(w) == F.count("*").over(w)
    worst = F.min(F.when(F.col("b_ret").isNotNull(), F.struct("b_ret", "i", "c_ret"))).over(w)
    rows = rows.withColumn("worst", F.when(whole & (F.col("i") >= window), worst))
    return rows.select("entity_id", "date", F.when(F.col("worst.b_ret") < 0, F.col("worst.c_ret") / F.when(F.col("worst.b_ret") < 0, F.col("worst.b_ret"))).alias("downside_capture"))
