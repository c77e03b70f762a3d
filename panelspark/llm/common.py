"""Shared helpers: batches of texts and numbers, text columns, rows told apart whose key is not their own."""

from __future__ import annotations

import contextlib
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.scratch import broadcast_below, discard, materialise, scratch_path

__all__ = ["broadcast_below", "discard", "materialise", "modest_batches", "number_batches", "numbered", "rows_of", "scratch_path", "table", "text_or_empty"]

#: Bytes of a single file from which, and up to which, it is dealt anew.
ONE_TASK, ONE_FILE = 1 << 20, 1 << 28
#: Repeated keys (8 bytes each) that may be broadcast.
REPEATED_KEYS = 1_000_000


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def number_batches(spark: SparkSession, rows: int = 50_000) -> Iterator[None]:
    """For jobs run inside: rows of a few numbers go to Python in larger batches than texts do."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def modest_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Texts are long: this session hands Python at most so many rows at a time (less, if it is set lower)."""
    if int(spark.conf.get(_BATCH)) > rows:
        spark.conf.set(_BATCH, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. One small file, which a single task would read, is dealt to all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if len(rows.inputFiles()) > 1:
        return rows
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(file).getLength()
    return rows.repartition(spark.sparkContext.defaultParallelism) if ONE_TASK <= size <= ONE_FILE else rows


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def rows_of(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of at most size rows, so that what Python holds at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _count_alike(names: list[str]):
    """Adds to each row how many rows of its key and name this task has seen before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            key, name = (batch.column(names.index(c)).to_pylist() for c in ("n_key", "n_name"))
            before = []
            for pair in zip(key, name, strict=True):
                before.append(seen[pair])
                seen[pair] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], [*names, "n_within"])

    return run


def numbered(docs: DataFrame, key: str = "doc_id", by: Sequence[str] = ("text",)) -> tuple[DataFrame, bool]:
    """row (all columns as one value), n_key (the key as a long) and n_occ of every row, and whether any n_occ is not 0.

    n_occ is 0 where the key is the row's own. Rows that share a key, or have none, get a number that tells them apart: a
    hash of what they hold in `by` and of their rank among rows alike in that. Ranks come from counts by task, so no task
    holds all rows of a key; which of some rows alike gets which rank is not defined, the set of numbers is. Only such rows
    are written down.
    """
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("n_key"))
    repeated = whole.groupBy("n_key").agg(F.count("*").alias("n")).where("n > 1 OR n_key IS NULL").select(F.col("n_key").alias("r_key"))
    repeated = materialise(repeated, "repeated-keys")
    if repeated.isEmpty():
        return whole.withColumn("n_occ", F.lit(0).cast("long")), False
    keys = broadcast_below(repeated.where("r_key IS NOT NULL"), REPEATED_KEYS)
    own = whole.where("n_key IS NOT NULL").join(keys, F.col("n_key") == F.col("r_key"), "left_anti").withColumn("n_occ", F.lit(0).cast("long"))
    shared = whole.join(keys, F.col("n_key") == F.col("r_key"), "left_semi").unionByName(whole.where("n_key IS NULL"))
    shared = shared.withColumns({"n_name": F.xxhash64(*[F.col("row")[c] for c in by]), "n_part": F.spark_partition_id()})
    shared = shared.mapInArrow(_count_alike(shared.columns), shared.select("*").schema.add("n_within", "long"))
    shared = materialise(shared, "shared-keys")
    sizes = shared.groupBy("n_key", "n_name", "n_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("n_key", "n_name").orderBy("n_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    bases = sizes.select(F.col("n_key").alias("b_key"), F.col("n_name").alias("b_name"), F.col("n_part").alias("b_part"), F.sum("n").over(before).alias("base"))
    bases = broadcast_below(bases.where("base IS NOT NULL"), REPEATED_KEYS)
    same = F.col("n_key").eqNullSafe(F.col("b_key")) & (F.col("n_name") == F.col("b_name")) & (F.col("n_part") == F.col("b_part"))
    rank = F.coalesce(F.col("base"), F.lit(0)) + F.col("n_within")
    shared = shared.join(bases, same, "left").select("row", "n_key", F.xxhash64("n_name", rank).bitwiseOR(F.lit(1).cast("long")).alias("n_occ"))
    return own.unionByName(shared), True
