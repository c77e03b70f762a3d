"""From raw documents to packed training sequences: five stages, each written as Parquet before the next reads it.

Defined results: each stage but the last returns the columns of documents, extra ones included, whatever their names; an empty
table passes through all stages as an empty one. A null text is scored and compared as the empty text, keeps no lines and
packs as its end token. Rows that share a doc_id, or have none, are documents of their own in every stage; of rows alike in
doc_id and text the near-duplicate stage keeps one. Ties go to the smaller doc_id. Very long texts are never cut but by packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import lines, mixing, near_texts, packing, toxicity
from panelspark.llm.common import materialise, table
from panelspark.llm.tokenizer import vocabulary
from panelspark.scratch import mark, release

SEQUENCE = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("toxicity") < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its text without lines that stay elsewhere; n_chars follows the text."""
    kept = lines.dedup_lines(docs, report=False)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays. Linked are fingerprints within the
    distance of the SimHash operator, and texts whose five-word shingles reach a Jaccard similarity of 0.8."""
    return near_texts.one_of_each(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows repeat, or go."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), 0, SEQUENCE)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Hashing, tokenising and a fitted classifier are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way, and its predecessor's rows, go once its own rows are written."""
    docs = table(spark, sf_dir, "documents")
    start = mark()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        release(spark, start, keep=docs)
    return docs
