"""Choosing a pilot universe: symbols, eras, families, adversarial pools, proportional and stratified draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.sources.bars import KEY, series

#: Index names by the family they stand for, the widest first match counts.
FAMILIES = (("sp500", ("sp500",)), ("sp400_600", ("sp400", "sp600")), ("russell_only", ("r1000", "r2000", "r3000", "ndx100")))


def base_symbol(symbol: Column) -> Column:
    """A symbol without the listing date that a delisted one carries."""
    return F.regexp_replace(symbol, r"-\d{6}$", "")


def era(date: Column) -> Column:
    return F.when(date < F.lit("1990-01-01").cast("date"), "pre1990").when(date < F.lit("2010-01-01").cast("date"), "1990_2009").otherwise("2010_present")


def index_family(names: Column) -> Column:
    """The family of a set of index names; none if it holds none of them."""
    out = F.lit("none")
    for family, members in reversed(FAMILIES):
        out = F.when(F.arrays_overlap(names, F.array(*(F.lit(m) for m in members))), family).otherwise(out)
    return out


def bankrupt(symbol: Column, name: Column) -> Column:
    return base_symbol(symbol).endswith("Q") | F.coalesce(name.rlike("(?i)liquidat|bankrupt"), F.lit(False))


def reverse_splits(bars: DataFrame, ratio: float = 1.5) -> DataFrame:
    """Entities whose adjustment factor once fell by the ratio or more."""
    before = F.lag("adj_factor").over(series())
    marked = bars.where("adj_factor IS NOT NULL").select(KEY, (before / F.when(F.col("adj_factor") > 0, F.col("adj_factor")) >= ratio).alias("hit"))
    return marked.where("hit").select(KEY).distinct()


def first_eligible(eligible: DataFrame, memberships: DataFrame) -> DataFrame:
    """entity_id, first date, and the names of the indexes that hold the entity on it (empty if none)."""
    first = eligible.where("eligible").groupBy(KEY).agg(F.min("date").alias("first_date"))
    m = memberships.select(F.col(KEY).alias("m_id"), "index_name", "from_date", "to_date")
    on = (F.col(KEY) == F.col("m_id")) & (F.col("from_date") <= F.col("first_date")) & (F.col("to_date").isNull() | (F.col("to_date") >= F.col("first_date")))
    return first.join(m, on, "left").groupBy(KEY, "first_date").agg(F.sort_array(F.collect_set("index_name")).alias("indexes"))


def proportional_allocation(cells: DataFrame, total: int, keys: list[str]) -> DataFrame:
    """cells (keys, n) with take: the floor of the proportion, the remainder to the largest cell (the last key on a tie).

    A largest cell that cannot hold the remainder fails the job. One row a cell, so a single ordered pass.
    """
    every = Window.partitionBy(F.lit(0))
    floor = F.floor(F.lit(total) * F.col("n") / F.sum("n").over(every))
    rows = cells.withColumn("take", F.least("n", floor)).withColumn("place", F.row_number().over(every.orderBy(F.desc("n"), *(F.desc(k) for k in keys))))
    take = F.when(F.col("place") == 1, F.col("take") + total - F.sum("take").over(every)).otherwise(F.col("take"))
    rows = rows.withColumn("take", take).drop("place")
    fits = F.when(F.col("take") <= F.col("n"), F.col("take")).otherwise(F.raise_error(F.lit("the largest cell cannot take the remainder")).cast("long"))
    return rows.withColumn("take", fits)


def stratified_sample(rows: DataFrame, keys: list[str], total: int, key: str = KEY, seed: int = 0) -> DataFrame:
    """Rows drawn by a seeded hash within each cell, as many as the allocation gives it."""
    takes = proportional_allocation(rows.groupBy(*keys).agg(F.count("*").alias("n")), total, keys)
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    ranked = rows.withColumn("draw", F.row_number().over(order))
    return ranked.join(takes.select(*keys, "take"), keys).where("draw <= take").drop("draw", "take")


def index_coverage(intervals: DataFrame, required: DataFrame) -> DataFrame:
    """index_name, earliest, required_from, n_entities and ok: whether membership reaches back as far as it must."""
    per = intervals.groupBy("index_name").agg(F.min("from_date").alias("earliest"), F.count_distinct(KEY).alias("n_entities"))
    return required.join(per, "index_name", "left").withColumn("ok", F.coalesce(F.col("earliest") <= F.col("required_from"), F.lit(False)))


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the greatest order for each key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("r")).select(key, "r.*")
