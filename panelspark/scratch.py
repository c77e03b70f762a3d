"""Tables written on the way: the folder that driver and executors share, and orders over whole tables that no one task holds."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Paths written by this process and not deleted yet.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is named, a temporary one if the master is local; an error otherwise,
    for executors elsewhere would write to disks of their own."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='panelspark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/panelspark/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more, and lets Spark drop the shuffles of finished jobs."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/panelspark/" in path:
                _delete(df.sparkSession, path)
                _written[:] = [p for p in _written if p.rsplit("/", 1)[-1] != path.rsplit("/", 1)[-1]]
    gc.collect()
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def mark() -> int:
    """A place in the list of written tables, for release()."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes every table written since a mark() (all, by default) but the one that keep was read from.

    A lazy result reads the tables it was built from, so this is called once the result is written elsewhere or done with.
    """
    kept = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()} if keep is not None else set()
    for path in _written[since:]:
        if path.rsplit("/", 1)[-1] not in kept:
            _delete(spark, path)
            _written.remove(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_below(df: DataFrame, rows: int) -> DataFrame:
    """Marks df for broadcast only if a count proves it to have at most that many rows; else AQE picks the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_order(df: DataFrame, order: Sequence[Column], amount: Column | None = None, name: str = "before", total: str | None = None, descending: bool = False) -> DataFrame:
    """df with a column: the sum of amount (by default 1 a row) over all rows that stand before the row in the whole order.

    Rows are dealt to tasks by ranges of the order and written down; sums of the ranges, one number a task, give each
    range its start. Rows equal in order stand next to each other in no defined order. total adds the sum over all rows.
    """
    amount = F.lit(1).cast("long") if amount is None else amount
    rows = df.select(F.struct(*df.columns).alias("o_row"), amount.alias("o_amount"), *[c.alias(f"o_{k}") for k, c in enumerate(order)])
    by = [F.col(f"o_{k}").desc() if descending else F.col(f"o_{k}") for k in range(len(order))]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("o_row", "o_amount", F.monotonically_increasing_id().alias("o_at"))
    rows = materialise(rows, "ordered").withColumn("o_part", F.shiftright("o_at", 33))
    sums = rows.groupBy(F.col("o_part").alias("s_part")).agg(F.sum("o_amount").alias("s_sum"))
    # One row for each range: as many as there are shuffle partitions.
    every = Window.orderBy("s_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = Window.orderBy("s_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    sums = sums.select("s_part", F.coalesce(F.sum("s_sum").over(so_far), zero).alias("s_before"), F.sum("s_sum").over(every).alias("s_total"))
    inside = Window.partitionBy("o_part").orderBy("o_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("o_inside", F.coalesce(F.sum("o_amount").over(inside), zero)).join(F.broadcast(sums), F.col("o_part") == F.col("s_part"))
    extra = [(F.col("s_before") + F.col("o_inside")).alias(name), *([F.col("s_total").alias(total)] if total else [])]
    return rows.select("o_row.*", *extra)
