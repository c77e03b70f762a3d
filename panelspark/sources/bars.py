"""Bars and their companions, derived from the order tables: what a price source would otherwise deliver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = "entity_id"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(key: str = KEY):
    """The one window order of the library: an entity's bars by date."""
    return Window.partitionBy(key).orderBy("date")


def trailing(before: int, to: int = 0):
    return series().rowsBetween(-before, -to)


def so_far():
    return series().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, date, open, high, low, close, volume: a geometric walk driven by the day's discounts.

    Returns are summed as decimals, so that the walk does not depend on the order in which rows arrive.
    """
    lines = table(spark, sf_dir, "lineitem")
    days = lines.groupBy(F.col("l_suppkey").alias(KEY), F.to_date("l_shipdate").alias("date")).agg(
        F.round(F.avg("l_discount") - 0.05, 6).cast("decimal(12,6)").alias("r"),
        F.max("l_tax").alias("tx"), F.min("l_tax").alias("tn"), F.sum("l_quantity").alias("volume"),
    )
    days = days.withColumn("close", F.round(F.lit(100.0) * F.exp(F.sum("r").over(so_far()).cast("double")), 4))
    days = days.withColumn("open", F.coalesce(F.lag("close").over(series()), F.lit(100.0)))
    high = F.greatest("open", "close") * (1 + F.col("tx") / 4)
    low = F.least("open", "close") * (1 - F.col("tn") / 4)
    return days.select(KEY, "date", "open", high.alias("high"), low.alias("low"), "close", "volume")


def adjusted_bars(bars: DataFrame, split_date: str = "1998-01-01") -> DataFrame:
    """Bars with raw prices before a 2:1 split of even entities: raw_close and adj_factor = close / raw_close."""
    split = (F.col(KEY) % 2 == 0) & (F.col("date") < F.lit(split_date).cast("date"))
    factor = F.when(split, 0.5).otherwise(1.0)
    return bars.withColumns({"raw_close": F.col("close") / factor, "adj_factor": factor})


def benchmark(bars: DataFrame) -> DataFrame:
    """date and bench_close: the mean close over entities, as a decimal sum so that row order does not matter."""
    total = F.sum(F.col("close").cast("decimal(18,4)")).cast("double")
    return bars.groupBy("date").agg((total / F.count("*")).alias("bench_close"))


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, nation, region, sector and is_delisted."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entities = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return entities.select(F.col("s_suppkey").alias(KEY), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("n_regionkey").alias("sector"), (F.col("s_acctbal") < 0).alias("is_delisted"))


def member_days(spark: SparkSession, sf_dir: str, bars: DataFrame) -> DataFrame:
    """Bars with a membership flag: days on which the entity has a line of return flag N."""
    n = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_suppkey").alias(KEY), F.to_date("l_shipdate").alias("date")).distinct()
    return bars.join(n.withColumn("member", F.lit(True)), [KEY, "date"], "left").withColumn("member", F.coalesce("member", F.lit(False)))


def points(bars: DataFrame, first: int = 252, every: int = 5) -> DataFrame:
    """Observation points: every fifth bar from index 252; point_id is the pair's own key."""
    at = bars.withColumn("bar_idx", F.row_number().over(series()) - 1)
    at = at.where((F.col("bar_idx") >= first) & ((F.col("bar_idx") - first) % every == 0))
    return at.select(F.concat_ws("-", KEY, "bar_idx").alias("point_id"), KEY, "date", "bar_idx")


def gapped(bars: DataFrame) -> DataFrame:
    """Bars whose opens stand up to 3 percent off the close before, by the day's volume: for events that need gaps."""
    shifted = F.col("open") * (1 + (F.col("volume").cast("long") % 7 - 3) / F.lit(100.0))
    rows = bars.withColumn("open", shifted)
    return rows.withColumns({"high": F.greatest("high", "open"), "low": F.least("low", "open")})
