"""Document fingerprints from closed syncmers, in built-in functions alone.

A text is read as words (of long unspaced runs, characters or pieces). A k-mer of
words is a closed syncmer if the smallest hash among its inner s-mers lies at its first or last one. That depends on the
k-mer alone, so an anchor survives any edit that leaves its own words. anchors() lists them with their positions, for
positional matching; the fingerprint keeps the smallest SKETCH anchor hashes, and likeness() estimates from two
fingerprints the share of anchors that the texts have in common (exactly, where neither is full).

Defined results: a null text is the empty text; a text without words has the empty fingerprint, alike (1.0) only to itself;
a text of fewer than k words has its whole word sequence as its one anchor; other columns are ignored. In
fingerprint_edits(), rows follow each other by descending doc_id, null last, rows of one doc_id in an order of their
texts, and the last row by the first; rows alike in both follow each other; a single row follows itself; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.common import materialise, text_or_empty

K, S = 5, 2
SKETCH = 64
#: Documents of a block of the order, and blocks at most (of more documents each, then).
BLOCK_ROWS, MOST_BLOCKS = 4_000, 65_536
#: Copies of a row that one task writes out before the next task does.
LOT = 1_000
PLACE = "struct<known:boolean,id:bigint,tie:bigint>"
#: A longer unspaced run is cut: each character of a script written without spaces is a word, others go by so many.
LONGEST_WORD = 32
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_PIECE = f"[{UNSPACED}]|[^{UNSPACED}]{{1,{LONGEST_WORD}}}"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def word_hashes(text: Column) -> Column:
    """The hash of each word of a text, in order."""
    cut = lambda w: F.when(F.length(w) > LONGEST_WORD, F.regexp_extract_all(w, F.lit(_PIECE), F.lit(0))).otherwise(F.array(w))
    whole = lambda words: F.when(F.exists(words, lambda w: F.length(w) > LONGEST_WORD), F.flatten(F.transform(words, cut))).otherwise(words)
    words = let(F.split(F.lower(text), r"\s+"), whole)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _syncmers(words: Column, with_position: bool) -> Column:
    """Hashes of the closed syncmers of an array of word hashes (at least K of them)."""

    def of(smers: Column) -> Column:
        at = lambda i, j: F.get(smers, i + j) if j else F.get(smers, i)
        inner = range(1, K - S)
        closed = lambda i: F.least(at(i, 0), at(i, K - S)) <= F.least(*[at(i, j) for j in inner])
        places = F.filter(F.sequence(F.lit(0), F.size(smers) - (K - S + 1)), closed)
        name = lambda i: F.xxhash64(*[at(i, j) for j in range(0, K - S + 1)])
        return F.transform(places, (lambda i: F.struct(i.alias("position"), name(i).alias("anchor"))) if with_position else name)

    smers = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.xxhash64(a, b))
    return let(smers, of)


def syncmer_hashes(text: Column) -> Column:
    """The anchor hashes of a text, in order."""
    few = lambda w: F.when(F.size(w) > 0, F.array(F.aggregate(w, F.lit(42).cast("long"), lambda h, x: F.xxhash64(h, x)))).otherwise(F.array().cast("array<bigint>"))
    return let(word_hashes(text), lambda w: F.when(F.size(w) < K, few(w)).otherwise(_syncmers(w, False)))


def anchors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, position (in words) and anchor of every closed syncmer of every text of at least K words."""
    found = let(word_hashes(text_or_empty(text_column)), lambda w: F.when(F.size(w) >= K, _syncmers(w, True)))
    return docs.select(F.col(id_column).alias("doc_id"), F.inline(found))


def positional_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, offset and matches: how many anchors two sides of anchors() share at each shift of position.

    right should be the smaller, stated side; anchors that occur more than once in a document count once a shift.
    """
    a = left.select(F.col("doc_id").alias("left_id"), F.col("position").alias("l_position"), "anchor")
    b = right.select(F.col("doc_id").alias("right_id"), F.col("position").alias("r_position"), "anchor")
    shared = a.join(b, "anchor").select("left_id", "right_id", (F.col("l_position") - F.col("r_position")).alias("offset"), "anchor")
    return shared.groupBy("left_id", "right_id", "offset").agg(F.count_distinct("anchor").alias("matches"))


def sketch(text: Column) -> Column:
    """The smallest SKETCH distinct anchor hashes of a text."""
    return F.slice(F.sort_array(F.array_distinct(syncmer_hashes(text))), 1, SKETCH)


def printed(sketched: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash."""
    return F.array_join(F.transform(sketched, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common anchors of two sketches: those of the smallest of either that are in both."""

    def of(joint: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(joint, a), b))
        return F.when(F.size(joint) == 0, F.lit(1.0)).otherwise(both.cast("double") / F.size(joint))

    return let(F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, SKETCH), of)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, however often later expressions name them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def place() -> Column:
    """Where a row (doc_id, tie) stands; the order goes from the greatest place down."""
    return F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("tie"))


def block_starts(docs: DataFrame, rows: int = BLOCK_ROWS, most: int = MOST_BLOCKS) -> list[tuple[bool, int, int]]:
    """Places that begin the blocks of about so many rows, descending; the first is the greatest of all.

    They are picked from a sample of about 20 places a block by hash, at most 20 * MOST_BLOCKS whatever the corpus.
    """
    size = docs.agg(F.count("*").alias("n"), F.max(place()).alias("top")).first()
    if not size["n"]:
        return []
    blocks = min(most, -(-size["n"] // rows))
    share = min(1.0, 20 * blocks / size["n"])
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(1 << 30)) < int(share * (1 << 30))).select(place().alias("p")).distinct()
    found = sorted((tuple(r["p"]) for r in drawn.collect()), reverse=True)
    return sorted({tuple(size["top"]), *found[:: max(1, len(found) // blocks)]}, reverse=True)


def in_blocks(docs: DataFrame, starts: list[tuple[bool, int, int]]) -> DataFrame:
    """Adds block and guest to docs (doc_id, tie, ...): a block's first row is also the last, a guest, of the block before it (of the last block, for the first)."""
    if not starts:
        return docs.select("*", F.lit(0).alias("block"), F.lit(False).alias("guest"))
    step = math.isqrt(len(starts) - 1) + 1
    named = [{"known": known, "id": i, "tie": tie} for known, i, tie in starts]
    table = F.from_json(F.lit(json.dumps([named[k : k + step] for k in range(0, len(starts), step)])), f"array<array<{PLACE}>>")
    docs = once(docs, at=place())
    docs = once(docs, upper=F.size(F.filter(F.transform(table, lambda part: part[0]), lambda s: s >= F.col("at"))))
    part = F.get(table, F.col("upper") - 1)
    docs = once(docs, lower=F.size(F.filter(part, lambda s: s >= F.col("at"))), part=part)
    last = len(starts) - 1
    block = ((F.col("upper") - 1) * step + F.col("lower") - 1).cast("int")
    first = F.get(F.col("part"), F.col("lower") - 1) == F.col("at")
    stand = lambda b, g: F.struct(b.cast("int").alias("block"), F.lit(g).alias("guest"))
    before = F.when(block == 0, last).otherwise(block - 1)
    places = F.when(first, F.array(stand(block, False), stand(before, True))).otherwise(F.array(stand(block, False)))
    return docs.select(*[c for c in docs.columns if c not in ("at", "upper", "lower", "part")], F.inline(places))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    Texts are shuffled once, into blocks of the order; all else happens in their rows. Where ids repeat or are missing, rows
    alike in id and text are first made one row that knows how many they are (copies meet map-side), so that a block
    never holds all rows of an id; all but the last of them are followed by a row like themselves.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    shared = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()
    if shared:
        docs = docs.groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("tie", F.xxhash64("text"))
        docs = materialise(docs, "distinct-rows")
    else:
        docs = docs.withColumn("tie", F.lit(0).cast("long"))
    rows = in_blocks(docs, block_starts(docs)).repartition("block")
    rows = once(rows, own=sketch(F.col("text")))
    order = Window.partitionBy("block").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.desc("tie"), "text")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    rows = rows.withColumns({"next_text": following("text"), "next_own": following("own")}).where("NOT guest")
    if shared:
        after = lambda text, own, times: F.struct(text.alias("next_text"), own.alias("next_own"), times.cast("long").alias("times"))
        last = after(F.col("next_text"), F.col("next_own"), F.lit(1))
        others = F.when(F.col("copies") > 1, F.array(last, after(F.col("text"), F.col("own"), F.col("copies") - 1))).otherwise(F.array(last))
        rows = rows.select("doc_id", "text", "own", F.inline(others))
    cut = F.floor(F.length("text") / 3).cast("int")
    rows = once(rows, cut=cut)
    rows = once(rows, edited=F.expr("concat(left(text, length(text) - cut), left(next_text, cut))"))
    rows = once(rows, other=sketch(F.col("edited")))
    out = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        printed(F.col("own")).alias("fingerprint"), printed(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"), *(["times"] if shared else []),
    )
    if not shared:
        return out
    out = materialise(out, "fingerprints")
    lots = out.where("times > 1").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / LOT)))).repartition("doc_id", "lot")
    copies = lots.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.least(F.lit(LOT), F.col("times") - F.col("lot") * LOT).cast("int"))))
    return out.where("times = 1").drop("times").unionByName(copies.drop("times", "lot", "copy"))
