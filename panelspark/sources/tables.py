"""Sources and sinks: Parquet, CSV, JSON and JDBC in; overwrite, upsert, insert-ignore, partition replace and staged update out.

Without a table format that has transactions, an upsert is an anti-join and a union written to a new version of the folder
and then swapped in by a pointer file, so a reader never sees half a write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Any Spark format; CSV and JSON should be given a schema, so that nothing is read twice to guess it."""
    reader = spark.read.format(fmt).options(**{k: str(v) for k, v in options.items()})
    return (reader.schema(schema) if schema else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, query: str, column: str, lower: int, upper: int, partitions: int) -> DataFrame:
    """One partitioned scan of a database query, instead of a query an entity."""
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions).load()


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = (), **options) -> None:
    writer = df.write.format(fmt).mode(mode).options(**{k: str(v) for k, v in options.items()})
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


class VersionedTable:
    """A folder of versions and a pointer to the current one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _pointer(self) -> str | None:
        hadoop, fs = _fs(self.spark, f"{self.path}/_current")
        if not fs.exists(hadoop):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(hadoop)]
        return max((n for n in names if "-" in n), default=None)

    def exists(self) -> bool:
        return self._pointer() is not None

    def read(self) -> DataFrame:
        pointer = self._pointer()
        if pointer is None:
            raise ValueError(f"no version of {self.path}")
        return self.spark.read.parquet(f"{self.path}/v-{pointer}")

    def _swap(self, df: DataFrame) -> None:
        before = self._pointer()
        number = int(before.split("-")[0]) + 1 if before else 1
        name = f"{number:012d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/v-{name}")
        hadoop, fs = _fs(self.spark, f"{self.path}/_current/{name}")
        fs.create(hadoop).close()  # an empty file: readers take the last name

    def replace(self, df: DataFrame) -> None:
        """Truncate and rebuild."""
        self._swap(df)

    def upsert(self, df: DataFrame, keys: list[str]) -> None:
        """Rows of df replace rows of the same key; df must hold each key once."""
        if not self.exists():
            return self._swap(df)
        old = self.read()
        self._swap(old.join(df.select(*keys), keys, "left_anti").select(*old.columns).unionByName(df, allowMissingColumns=True))

    def insert_ignore(self, df: DataFrame, keys: list[str]) -> None:
        """Rows whose key is not there yet, one for each key (the first by all columns)."""
        first = df.groupBy(*keys).agg(F.min(F.struct(*[c for c in df.columns if c not in keys])).alias("r")).select(*keys, "r.*") if set(df.columns) - set(keys) else df.distinct()
        if not self.exists():
            return self._swap(first.select(*df.columns))
        old = self.read()
        self._swap(old.unionByName(first.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True))

    def replace_scope(self, df: DataFrame, scope: list[str]) -> None:
        """Deletes every row whose scope values occur in df, then inserts df: repeated calls leave the same table."""
        if not self.exists():
            return self._swap(df)
        old = self.read()
        self._swap(old.join(df.select(*scope).distinct(), scope, "left_anti").select(*old.columns).unionByName(df, allowMissingColumns=True))

    def update_from(self, staged: DataFrame, keys: list[str], columns: list[str]) -> None:
        """Staged values, where there are any, take the place of old ones."""
        old = self.read()
        s = staged.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"s_{c}") for c in columns])
        joined = old.join(s, keys, "left")
        self._swap(joined.select(*[F.coalesce(f"s_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns]))


class TrialLog:
    """An append-only record of everything tried, so that the number of trials cannot be understated."""

    SCHEMA = "family string, name string, params string, sharpe double"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def record(self, trials: list[tuple[str, str, str, float]]) -> None:
        self.spark.createDataFrame(trials, self.SCHEMA).write.mode("append").parquet(self.path)

    def read(self, family: str | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return rows if family is None else rows.where(F.col("family") == family)

    def count(self, family: str | None = None) -> int:
        return self.read(family).count()
