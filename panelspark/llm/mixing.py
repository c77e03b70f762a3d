"""Mixing sources to target weights by capped water-filling and seeded repetition.

Targets: every source asks for its weight's share of the whole; a source stops at `max_epochs` times its size and what it
cannot take is shared anew by weight among the others, until none exceeds its cap. Rows: a target of e epochs takes every
document floor(e) times, and one time more those that come first in a seeded order, up to the fraction that is left.

Defined results: a null text has size 0; a null source is a source of its own, last in order; repeated rows count and are
taken one by one: rows that share a doc_id, or have none, stand in the seeded order by what they hold and their rank among
rows alike, so no key is taken or left as a whole; other columns are kept by mix() and ignored by plan(); an empty table
gives an empty result. A source of no words takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.common import broadcast_below, materialise, numbered, text_or_empty
from panelspark.scratch import in_order

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3.0
#: Sources (about 60 bytes each) that may be broadcast; beyond, AQE joins them by shuffle and splits hot ones.
BROADCAST_ROWS = 50_000
#: The seeded order of a source is cut into so many steps, whose words are summed before any rank is taken.
STEPS, COARSE = 65_536, 256


def words(text: Column) -> Column:
    """Number of spans of WORD."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def cyclic_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, in the code point order of sources, null last (sources: one row for each)."""
    placed = in_order(sources, [F.col("source").isNull(), F.col("source")], name="place")
    return placed.withColumn("weight", (F.col("place") % 3 + 1).cast("double")).drop("place")


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds target to sources (source, source_size, weight); only two sums leave the executors in each round.

    The level (words for each unit of weight) only rises from round to round, so it alone says which sources are clamped.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level, clamped = 0.0, -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        free = F.when(~full, F.col("weight"))
        r = sources.agg(F.count(F.when(full, 1)).alias("n"), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("held"), F.sum(free).alias("w")).first()
        if r["n"] == clamped or not r["w"]:
            break
        level, clamped = max(level, (total - r["held"]) / r["w"]), r["n"]
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _key(seed: int) -> Column:
    """A row's place in the seeded order."""
    return F.xxhash64(F.lit(seed).cast("long"), "n_key", "n_occ")


def source_targets(sized: DataFrame, max_epochs: float = MAX_EPOCHS, weights=cyclic_weights) -> DataFrame:
    """source, source_size, weight, target: one row for each source of sized (source, size)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return materialise(water_fill(materialise(weights(sources), "sources"), max_epochs), "targets")


def _step(key: Column) -> Column:
    return F.pmod(F.shiftright(key, 32), F.lit(STEPS)).cast("int")


def _with_times(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (source, key, ...) with the cut of their own source and times."""
    out = rows.join(broadcast_below(cuts, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("c_source")))
    step, key = _step(F.col("key")), F.col("key")
    extra = (step < F.col("c_step")) | ((step == F.col("c_step")) & (key <= F.col("c_last_key")))
    return out.withColumn("times", (F.col("c_whole") + F.when(extra, 1).otherwise(0)).cast("int"))


def _sized(rows: DataFrame, seed: int) -> DataFrame:
    size = words(F.coalesce(F.col("row")["text"].cast("string"), F.lit("")))
    sized = rows.select(F.col("row")["doc_id"].alias("doc_id"), F.col("row")["source"].alias("source"), size.alias("size"), _key(seed).alias("key"))
    return materialise(sized, "sizes")


def _edge(sums: DataFrame, step: str, rest: str) -> DataFrame:
    """The step of each source in which its running sum first reaches rest, and how much of rest is left at its start."""
    so_far = Window.partitionBy("source").orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("before", F.sum("step_words").over(so_far) - F.col("step_words"))
    return sums.where((F.col("before") < F.col(rest)) & (F.col("before") + F.col("step_words") >= F.col(rest))).withColumn("left", F.col(rest) - F.col("before"))


def source_cuts(sized: DataFrame, max_epochs: float = MAX_EPOCHS, weights=cyclic_weights) -> DataFrame:
    """One row for each source of sized (source, size, key): its target and how far the seeded order is taken."""
    targets = source_targets(sized, max_epochs, weights)
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(per + F.lit(1e-9)), F.lit(int(max_epochs)))
    targets = targets.withColumn("whole", whole)
    targets = targets.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))

    # The step of the seeded order in which a source's rest is used up, found in two passes over sums: at most COARSE sums a
    # source for the wide step, then the STEPS / COARSE sums inside it. No window ever holds more, however hot a source is.
    stepped = sized.withColumn("step", _step(F.col("key")))
    fine = materialise(stepped.groupBy("source", "step").agg(F.sum("size").alias("step_words")), "steps")
    rests = broadcast_below(targets.select(F.col("source").alias("t_source"), "rest"), BROADCAST_ROWS)
    wide = fine.groupBy("source", (F.col("step") / F.lit(STEPS // COARSE)).cast("int").alias("wide")).agg(F.sum("step_words").alias("step_words"))
    wide = wide.join(rests, F.col("source").eqNullSafe(F.col("t_source")))
    wide = _edge(wide, "wide", "rest").select(F.col("source").alias("w_source"), F.col("wide").alias("w_step"), "left")
    inner = fine.join(broadcast_below(wide, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("w_source")) & ((F.col("step") / F.lit(STEPS // COARSE)).cast("int") == F.col("w_step")))
    inner = inner.withColumnRenamed("left", "rest")
    edge = _edge(inner, "step", "rest").select(F.col("source").alias("e_source"), F.col("step").alias("e_step"), F.col("left").alias("e_rest"))
    edge = materialise(edge, "edges")

    # Inside that step, documents are taken in order for as long as each brings the source nearer to its target.
    inside = stepped.join(broadcast_below(edge, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("e_source")) & (F.col("step") == F.col("e_step")))
    inside = inside.groupBy("source", "key", "e_rest").agg(F.sum("size").alias("size"))
    in_order = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("up_to", F.sum("size").over(in_order)).where(F.col("up_to") - F.col("size") / 2 <= F.col("e_rest"))
    last = inside.groupBy(F.col("source").alias("l_source")).agg(F.max("key").alias("c_last_key"))
    cuts = targets.join(edge, F.col("source").eqNullSafe(F.col("e_source")), "left")
    cuts = cuts.join(last, F.col("source").eqNullSafe(F.col("l_source")), "left")
    cuts = cuts.select(F.col("source").alias("c_source"), F.col("source_size").alias("c_source_size"), F.col("target").alias("c_target"), F.col("whole").alias("c_whole"), F.col("e_step").alias("c_step"), "c_last_key")
    return materialise(cuts, "cuts")


def plan(docs: DataFrame, max_epochs: float = MAX_EPOCHS, seed: int = 7, weights=cyclic_weights) -> DataFrame:
    """doc_id, source, size, source_size, target, times: how often the mix takes each row of docs."""
    rows, _ = numbered(docs.select("doc_id", "source", "text"), by=("text", "source"))
    sized = _sized(rows, seed)
    out = _with_times(sized, source_cuts(sized, max_epochs, weights))
    return out.select("doc_id", "source", "size", F.col("c_source_size").alias("source_size"), F.col("c_target").alias("target"), "times")


def mix(docs: DataFrame, max_epochs: float = MAX_EPOCHS, seed: int = 7, weights=cyclic_weights) -> DataFrame:
    """The rows of docs, all columns kept, each as often as the plan takes it. Texts are not shuffled for few sources."""
    rows, _ = numbered(docs, by=("text", "source"))
    cuts = source_cuts(_sized(rows, seed), max_epochs, weights)
    # Each row travels as one value, so its column names cannot clash with those of the plan.
    rows = _with_times(rows.select("row", F.col("row")["source"].alias("source"), _key(seed).alias("key")), cuts)
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")
