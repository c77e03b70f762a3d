"""One row of each group of near-duplicate texts: SimHash within a distance, and word sets of a Jaccard similarity.

Equal texts are one node, named by their SHA-256. Nodes whose fingerprints SimHash links, and nodes whose five-word shingles
reach the similarity, are joined; of each component the row with the smallest doc_id stays.

Defined results: a null text is the empty text; rows without a doc_id are compared like all others and come last in the
choice; of rows alike in doc_id and text one stays, whichever; of one doc_id's rows with unlike texts each stands for
itself; all columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import simhash, word_sets
from panelspark.llm.common import broadcast_below, discard, materialise, text_or_empty
from panelspark.llm.components import connected_components

#: Rows that go, and components of more than one text (about 60 bytes each), that may be broadcast.
BROADCAST_ROWS = 500_000


def text_links(texts: DataFrame, distance: int = simhash.DISTANCE) -> DataFrame:
    """Links (a, b) between digests of texts (digest, text; each digest once)."""
    prints = materialise(simhash.fingerprints(texts, keep=("digest",)), "text-fingerprints")
    parts = simhash.linked_fingerprints(prints.select("fp").distinct(), distance)
    grouped = prints.join(parts, F.col("fp") == F.col("node"), "left").select("digest", F.coalesce("component", "fp").alias("part"))
    grouped = materialise(grouped, "text-parts")
    least = grouped.groupBy(F.col("part").alias("l_part")).agg(F.min("digest").alias("least"), F.count("*").alias("n")).where("n > 1")
    least = broadcast_below(materialise(least, "least-texts"), BROADCAST_ROWS)
    near = grouped.join(least, F.col("part") == F.col("l_part")).where("digest <> least").select(F.col("digest").alias("a"), F.col("least").alias("b"))
    return near.unionByName(word_sets.word_links(texts))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near duplicates of a row that stays."""
    digest = F.unhex(F.sha2(text_or_empty(), 256))
    texts = docs.select(digest.alias("digest"), text_or_empty().alias("text"))
    texts = materialise(texts.dropDuplicates(["digest"]), "distinct-texts")
    links = materialise(text_links(texts), "all-links")
    parts = connected_components(links)
    rows = docs.select(F.col("doc_id").cast("long").alias("c_id"), digest.alias("c_digest")).groupBy("c_id", "c_digest").agg(F.count("*").alias("c_rows"))
    rows = rows.join(parts, F.col("c_digest") == F.col("node"), "left").select("c_id", "c_digest", "c_rows", F.coalesce("component", "c_digest").alias("part"))
    rows = materialise(rows, "near-rows")
    first = F.min(F.struct(F.col("c_id").isNull().alias("none"), "c_id", "c_digest")).alias("best")
    best = rows.groupBy(F.col("part").alias("b_part")).agg(first, F.count("*").alias("n")).where("n > 1")
    chosen = F.col("best")["c_id"].eqNullSafe(F.col("c_id")) & (F.col("best")["c_digest"] == F.col("c_digest"))
    best = broadcast_below(materialise(best, "best-rows"), BROADCAST_ROWS)
    marked = rows.join(best, F.col("part") == F.col("b_part"), "left")
    marked = marked.select("c_id", "c_digest", (F.col("best").isNull() | chosen).alias("c_stays"), (F.col("c_rows") > 1).alias("c_repeats"))
    # Most rows stay and stand alone, so only the others travel.
    marked = materialise(marked.where("c_repeats OR NOT c_stays"), "near-marked")
    discard(texts, links, rows)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("w_id"), digest.alias("w_digest"))
    same = F.col("w_id").eqNullSafe(F.col("c_id")) & (F.col("w_digest") == F.col("c_digest"))
    joined = whole.join(broadcast_below(marked, BROADCAST_ROWS), same, "left").where("c_stays IS NULL OR c_stays")
    repeats = marked.where("c_stays AND c_repeats")
    if repeats.isEmpty():
        return joined.select("row.*")
    once = joined.where("c_repeats").dropDuplicates(["w_id", "w_digest"]).select("row.*")
    return joined.where("c_stays IS NULL OR NOT c_repeats").select("row.*").unionByName(once)
