"""Masks, fills, spans, quality scans, universe membership and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.functions.windows import safe_div
from panelspark.sources.bars import KEY, series, so_far, trailing

#: First date that is locked away, first date with index membership, and the price floor.
LOCKBOX_START, INDEX_START, MIN_PRICE = "2022-01-01", "1990-07-03", 1.0


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def finite(*names: str) -> Column:
    """All named values are numbers (not null, not NaN, not infinite)."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & ~F.isnan(F.col(n)) & (F.abs(F.col(n)) < float("inf"))
    return out


def in_spans(bars: DataFrame, spans: DataFrame, name: str = "in_span") -> DataFrame:
    """Bars with a flag: the date lies in one of the entity's spans (from_date, to_date, both inclusive, open end null).

    The entity is an equality, so the range never becomes a cross product; overlapping spans are one flag.
    """
    s = spans.select(F.col(KEY).alias("s_id"), F.col("from_date").alias("s_from"), F.col("to_date").alias("s_to"))
    inside = (F.col(KEY) == F.col("s_id")) & (F.col("date") >= F.col("s_from")) & (F.col("s_to").isNull() | (F.col("date") <= F.col("s_to")))
    hits = bars.select(KEY, "date").join(s, inside, "left_semi").distinct().withColumn(name, F.lit(True))
    return bars.join(hits, [KEY, "date"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def tradeable_mask(bars: DataFrame, spans: DataFrame, name: str = "tradeable") -> DataFrame:
    """volume above 0, finite, and outside every excluded span."""
    flagged = in_spans(bars, spans, "excluded")
    return flagged.withColumn(name, finite("volume") & (F.col("volume") > 0) & ~F.col("excluded")).drop("excluded")


def forward_fill(bars: DataFrame, mask: str, columns: list[str]) -> DataFrame:
    """Masked-out bars take the last good value; bars before the first stay; a good bar that is not a number stays so."""
    def filled(c: str) -> Column:
        last = F.last(F.when(F.col(mask) & finite(c), F.col(c)), ignorenulls=True).over(so_far())
        return F.when(~F.col(mask) & last.isNotNull(), last).otherwise(F.col(c))

    return bars.withColumns({c: filled(c) for c in columns})


def trim_leading(bars: DataFrame, mask: str) -> DataFrame:
    """Drops the bars before an entity's first good one."""
    return bars.withColumn("_seen", F.max(F.col(mask).cast("int")).over(so_far())).where("_seen = 1").drop("_seen")


def adjust(bars: DataFrame) -> DataFrame:
    """Highs, lows and opens scaled by adjusted over raw close."""
    factor = safe_div(F.col("close"), F.col("raw_close"))
    return bars.withColumns({c: F.col(c) * factor for c in ("open", "high", "low")}).withColumn("adj_factor", factor)


def clean_bars(bars: DataFrame, spans: DataFrame, min_price: float = MIN_PRICE, lockbox_start: str = LOCKBOX_START) -> DataFrame:
    """What detectors see: no locked dates, masked bars filled, leading ones cut. A cleaned close that is not positive fails the job."""
    bars = tradeable_mask(drop_lockbox(bars, lockbox_start), spans)
    good = F.col("tradeable") & finite("close", "high", "low") & (F.col("raw_close") >= min_price if "raw_close" in bars.columns else F.lit(True))
    bars = trim_leading(forward_fill(bars.withColumn("good", good), "good", ["open", "high", "low", "close"]), "good")
    checked = F.when(F.col("close") > 0, F.col("close")).otherwise(F.raise_error(F.lit("a cleaned close is not positive")).cast("double"))
    return bars.withColumn("close", checked).drop("tradeable", "good")


def in_lockbox(column: str = "date", start: str = LOCKBOX_START) -> Column:
    return F.col(column) >= day(start)


def drop_lockbox(df: DataFrame, start: str = LOCKBOX_START, column: str = "date") -> DataFrame:
    return df.where(~in_lockbox(column, start))


def assert_not_in_lockbox(df: DataFrame, start: str = LOCKBOX_START, column: str = "date") -> DataFrame:
    if not df.where(in_lockbox(column, start)).isEmpty():
        raise ValueError(f"rows on or after {start} are locked")
    return df


def islands(bars: DataFrame, flag: Column, name_from: str = "from_date", name_to: str = "to_date") -> DataFrame:
    """Maximal runs of bars with the flag: entity_id, first and last date, bars in the run."""
    rows = bars.select(KEY, "date", F.coalesce(flag, F.lit(False)).alias("f"), F.row_number().over(series()).alias("rn"))
    within = Window.partitionBy(KEY, "f").orderBy("date")
    runs = rows.withColumn("run", F.col("rn") - F.row_number().over(within)).where("f")
    return runs.groupBy(KEY, "run").agg(F.min("date").alias(name_from), F.max("date").alias(name_to), F.count("*").alias("n_bars")).drop("run")


def membership_intervals(days: DataFrame, flag: str = "member") -> DataFrame:
    """Runs of membership; a run that reaches the entity's last bar is open (to_date null)."""
    last = days.groupBy(KEY).agg(F.max("date").alias("last_date"))
    runs = islands(days, F.col(flag)).join(last, KEY)
    return runs.select(KEY, "from_date", F.when(F.col("to_date") < F.col("last_date"), F.col("to_date")).alias("to_date"))


def close_open_intervals(intervals: DataFrame, dims: DataFrame, last_quoted: DataFrame) -> DataFrame:
    """Open intervals of delisted entities end on their last quoted date."""
    rows = intervals.join(dims.select(KEY, "is_delisted"), KEY, "left").join(last_quoted, KEY, "left")
    end = F.when(F.col("to_date").isNull() & F.col("is_delisted"), F.col("last_quoted")).otherwise(F.col("to_date"))
    return rows.select(KEY, "from_date", end.alias("to_date"))


def build_intervals(days: DataFrame, crosswalk: DataFrame, most_unmapped: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(intervals of symbols with an entity, symbols without one); fails if too large a share has none."""
    symbols = days.select("symbol").distinct()
    unmapped = symbols.join(crosswalk, "symbol", "left_anti").withColumn("reason", F.lit("no entity"))
    total, missing = symbols.count(), unmapped.count()
    if total and missing / total > most_unmapped:
        raise ValueError(f"{missing} of {total} symbols have no entity")
    return membership_intervals(days.join(crosswalk, "symbol")), unmapped


def data_quality_scan(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Runs of bad bars by kind: phantom (no adjusted price on a traded day), explosion (adjusted far above raw) and splice
    (adjusted and raw returns disagree away from any corporate action, which covers three bars either side)."""
    adj, raw = F.col("close"), F.col("raw_close")
    acts = actions.select(KEY, "date").distinct().withColumn("is_action", F.lit(1))
    bars = bars.join(acts, [KEY, "date"], "left")
    ret = lambda c: F.when((F.lag(c).over(series()) > 0) & (F.col(c) > 0), F.log(F.col(c) / F.lag(c).over(series())))
    near = F.coalesce(F.max("is_action").over(series().rowsBetween(-3, 3)), F.lit(0)) == 1
    flags = {
        "phantom": (adj <= 0) & (raw > 0) & (F.col("volume") > 0),
        "explosion": (adj > 1000) & (raw > 0) & (safe_div(adj, raw) > 20),
        "splice": (F.abs(ret("close") - ret("raw_close")) > 0.05) & ~near,
    }
    bars = bars.withColumns({f"is_{k}": v for k, v in flags.items()})
    found = [islands(bars, F.col(f"is_{k}")).withColumn("kind", F.lit(k)) for k in flags]
    return found[0].unionByName(found[1]).unionByName(found[2])


def return_disagreement(a: DataFrame, b: DataFrame, tolerance: float = 0.02, least_dates: int = 3) -> DataFrame:
    """Runs over the common dates on which two sources' log returns differ by more than tolerance."""
    both = a.select(KEY, "date", F.col("close").alias("ca")).join(b.select(KEY, "date", F.col("close").alias("cb")), [KEY, "date"])
    both = both.withColumn("n_common", F.count("*").over(Window.partitionBy(KEY))).where(F.col("n_common") >= least_dates)
    ret = lambda c: F.when((F.lag(c).over(series()) > 0) & (F.col(c) > 0), F.log(F.col(c) / F.lag(c).over(series())))
    both = both.withColumn("apart", F.abs(ret("ca") - ret("cb")) > tolerance)
    return islands(both, F.col("apart"))


def eligibility(days: DataFrame, spans: DataFrame, lockbox_start: str = LOCKBOX_START, index_start: str = INDEX_START, min_price: float = MIN_PRICE, min_bars: int = 252) -> DataFrame:
    """Per bar: data_valid, price_ok, history_ok, member and eligible; average volumes over partial windows of 50 bars."""
    rows = in_spans(days, spans, "excluded").withColumn("i", F.row_number().over(series()) - 1)
    w = trailing(49)
    turnover = F.col("volume").cast("decimal(12,0)") * F.col("close").cast("decimal(16,4)")  # exact, whatever the order
    valid = finite("close", "volume") & (F.col("close") > 0) & (F.col("volume") > 0)
    rows = rows.withColumns({"data_valid": valid, "price_ok": F.col("close") >= min_price, "history_ok": F.col("i") >= min_bars - 1, "adv_50": F.avg("volume").over(w), "dollar_adv_50": F.sum(turnover).over(w).cast("double") / F.count(turnover).over(w)})
    eligible = ~in_lockbox("date", lockbox_start) & ~F.col("excluded") & (F.col("member") | (F.col("date") < day(index_start))) & F.col("data_valid") & F.col("price_ok") & F.col("history_ok")
    return rows.select(KEY, "date", "member", "excluded", "data_valid", "price_ok", "history_ok", F.round("adv_50", 6).alias("adv_50"), "dollar_adv_50", eligible.alias("eligible"))


def adjustment_offenders(bars: DataFrame, max_lag_days: int = 30) -> DataFrame:
    """Entities with unadjusted bars, or whose last adjusted bar lags their last bar."""
    per = bars.groupBy(KEY).agg(F.count_if(F.col("close").isNotNull() & F.col("adj_factor").isNull()).alias("n_unadjusted"), F.max("date").alias("last_bar"), F.max(F.when(F.col("adj_factor").isNotNull(), F.col("date"))).alias("last_adjusted"))
    late = F.col("last_adjusted").isNull() | (F.datediff("last_bar", "last_adjusted") > max_lag_days)
    return per.where((F.col("n_unadjusted") > 0) | late)


def crosswalk(entities: DataFrame, tickers: DataFrame) -> DataFrame:
    """Entities and active tickers whose symbols agree once dots are dashes."""
    t = tickers.where("active").select(F.col("ticker_id"), F.col("symbol").alias("t_symbol"))
    return entities.join(t, F.regexp_replace("symbol", r"\.", "-") == F.col("t_symbol")).select(KEY, "ticker_id", "symbol")


def restatement_incidence(pairs: DataFrame, before: str, after: str, tolerance: float = 0.01) -> DataFrame:
    """One row: pairs compared and the share whose value changed by more than tolerance, relatively."""
    known = F.col(before).isNotNull() & F.col(after).isNotNull() & ~F.isnan(before) & ~F.isnan(after) & (F.col(before) != 0)
    moved = F.abs(safe_div(F.col(after) - F.col(before), F.col(before))) > tolerance
    return pairs.agg(F.count_if(known).alias("n_compared"), F.avg(F.when(known, moved.cast("int"))).alias("incidence"))


def knee_floor(values: DataFrame, column: str) -> DataFrame:
    """One row: the value at the knee of the sorted log10 curve, by the largest distance from its chord."""
    logs = values.where(F.col(column) > 0).select(F.log10(column).alias("y"))
    # Few numbers an entity: one sorted pass gives the rank, and the rest is closed form.
    ranked = logs.withColumn("x", F.row_number().over(Window.orderBy("y")) - 1)
    ends = ranked.agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.max("x").alias("n"))
    at = ranked.join(F.broadcast(ends), F.lit(True))
    gap = F.abs(safe_div(F.col("x"), F.col("n")) - safe_div(F.col("y") - F.col("lo"), F.col("hi") - F.col("lo")))
    best = F.max_by(F.col("y"), F.struct(F.round(gap, 9).alias("g"), (-F.col("x")).alias("x")))
    return at.agg(F.round(F.pow(F.lit(10.0), best), 4).alias("floor"), F.count("*").alias("n"))
