"""Token counts through a digest cache.

A text's key is the SHA-256 of its content; a tokenizer's key is the SHA-256 of its vocabulary file. Counts are looked up
in the cache of that tokenizer; only distinct contents that it lacks are encoded, and are then appended to it.

Defined results: a null text counts as the empty text (0 bytes, 0 tokens); repeated rows are each returned; a null doc_id
is returned as null; texts of any length are counted whole; other columns of the input are ignored; an empty table gives an
empty result. Two calls that append at once may both count a text: the cache may hold a digest twice, never two counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import tokenizer
from panelspark.llm.common import materialise, modest_batches, rows_of, scratch_path, text_or_empty

CACHE_SCHEMA = "digest binary, n_tokens long"
#: So many missing digests (32 bytes each) may be broadcast to keep known texts out of the shuffle.
BROADCAST_ROWS = 50_000


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _cached(spark: SparkSession, path: str) -> DataFrame:
    """The cache, or an empty one where nothing has been written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 256):
            n = tokenizer.counts(path, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return encode


def token_counts(docs: DataFrame, tokenizer_path: str, cache_dir: str | None = None) -> DataFrame:
    """doc_id, digest, n_bytes and n_tokens of every row of docs (doc_id, text).

    cache_dir keeps counts between calls, in one folder for each tokenizer digest; None starts an empty cache.
    """
    modest_batches(docs.sparkSession)
    spark = docs.sparkSession
    cache_path = f"{cache_dir or scratch_path(spark, 'token-cache')}/{tokenizer_digest(tokenizer_path)}"
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    docs = docs.select("doc_id", "text", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"))
    keys = materialise(docs.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")
    cache = _cached(spark, cache_path)
    missing = keys.select("digest").distinct().join(cache, "digest", "left_anti")
    known = not cache.isEmpty()
    if known:
        missing = materialise(missing, "token-misses")
    if not known or not missing.isEmpty():
        texts = docs.select("digest", "text")
        if known and missing.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
        # Copies meet in the map-side half of this aggregation, so a group of copies never fills one task.
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if known:
            texts = texts.join(missing, "digest", "left_semi")
        texts.mapInArrow(_encode(tokenizer_path), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keys.join(cache, "digest").select("doc_id", "digest", "n_bytes", "n_tokens")
