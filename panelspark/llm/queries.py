"""One query for each operator, over the whole of its tables and with production parameters, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import extraction, lines, mixing, packing, simhash, syncmers, token_counts, topk, toxicity, warc
from panelspark.llm.common import scratch_path, table
from panelspark.llm.tokenizer import vocabulary

CONTEXT, SEQUENCE = 512, 2048


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is empty at first, so each call of the query counts every distinct text."""
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > CONTEXT).alias("over_limit"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 0, SEQUENCE)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "source", "times")


def op4_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", "text", F.length("text").cast("long").alias("n_chars"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, scale=256)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.resolve_revisits(table(spark, sf_dir, "pages")), path)
    records = warc.read_archives(spark, path, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_best_fit_packing, op3_source_mixing, op4_syncmer_fingerprints, op5_html_extraction, op6_simhash, op7_line_dedup, op8_top_k, op9_warc, op10_toxicity)
}

#: Queries that SQL can express in full; the others are tested against brute force, round trips or held-out labels.
ORACLES = {
    # The tables' pages hold their article in one element; SQL can cut it out, though not decide what an article is.
    "op5_html_extraction": r"""
        WITH a AS (
          SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|<footer>|$)', 1) AS x FROM pages
        ), b AS (
          SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM a
        ), c AS (
          SELECT page_id, url, replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&#x27;', chr(39)), '&copy;', '©'), '&amp;', '&') AS x FROM b
        ), d AS (
          SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM c
        )
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
    """,
    "op8_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c AS (
          SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                 CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id
          WHERE a.vec_id % 50 = 0
        ), r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM c
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op9_warc": """
        WITH p AS (
          SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
          SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
}
