"""Labels, controls, entries, outcomes and entry events."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.functions.anchor_kernels import LABELS, VARIANTS, Panel, Rules, all_events, outcome
from panelspark.functions.windows import safe_div
from panelspark.operators.detect import per_entity
from panelspark.scratch import materialise
from panelspark.sources.bars import KEY, series, trailing

EVENT = "entity_id long, event_date date, bar_idx int, family string, variant_tag string, entry_price double, stop_price double, native_stop double, outcome string, outcome_date date, fwd_mfe double, fwd_mae double, bars_to_resolution int"


def setup_labels(bars: DataFrame, troughs: DataFrame, k: int = 20, every: int = 5, first: int = 252) -> DataFrame:
    """Points every few bars, positive if a trough (entity_id, trough_idx) lies in [i, i + k]; repeated troughs fail the job."""
    troughs = materialise(troughs.select(KEY, "trough_idx"), "troughs")  # so that the check does not run the detector again
    if not troughs.groupBy(KEY, "trough_idx").count().where("count > 1").isEmpty():
        raise ValueError("troughs repeat: pass one scale")
    rows = bars.withColumn("i", F.row_number().over(series()) - 1)
    marked = rows.join(troughs.select(KEY, F.col("trough_idx").alias("t_idx")), (rows[KEY] == troughs[KEY]) & (F.col("i") == F.col("t_idx")), "left").select(rows[KEY], "date", "i", "t_idx")
    ahead = F.min("t_idx").over(series().rowsBetween(0, k))
    points = marked.withColumn("linked", ahead).where((F.col("i") >= first) & ((F.col("i") - first) % every == 0))
    return points.select(KEY, "date", F.col("i").alias("as_of_index"), F.col("linked").isNotNull().alias("label"), F.lit(k).alias("forward_window_k"), (F.col("linked") - F.col("i")).alias("lead_time_days"), F.col("linked").alias("linked_trough_index"))


#: A prime beyond any bucket's size: multiples of it are distinct places.
STRIDE = 2_147_483_647


def liquidity_quintile(rows: DataFrame, value: str, within: str = "date", buckets: int = 5) -> DataFrame:
    """Equal-width cuts of the rank within each group, ties by entity: the bucket of a rank is as quantile edges give it."""
    w = Window.partitionBy(within)
    rank, n = F.row_number().over(w.orderBy(value, KEY)) - 1, F.count("*").over(w)
    b = F.least(F.lit(buckets), n)
    cut = F.ceil(safe_div(rank * b, n - 1) - 1e-12) - 1
    return rows.withColumn("size_bucket", F.when(n == 1, 0).otherwise(F.greatest(F.lit(0), F.least(b - 1, cut))).cast("int"))


def matched_controls(cases: DataFrame, pool: DataFrame, match: list[str], n: int = 1, seed: int = 0, exclude_same: bool = True) -> DataFrame:
    """For each case (case_id) n rows of the pool (control_id) that agree on match, drawn by a seeded hash from all such rows.

    Pool rows are numbered within a bucket, an entity's rows side by side, so that a case passes over its own entity's rows by
    their place; its draws are distinct places of the rest, a fixed stride apart. No bucket is ever paired off in full.
    """
    classes = {"sector", "industry", "gics", "gics_name"}
    if classes & set(match) and not ("is_delisted" in pool.columns and "is_delisted" in cases.columns):
        raise ValueError("matching on a classification needs is_delisted on both sides")
    own = Window.partitionBy(*match)
    order = lambda c: F.xxhash64(F.lit(seed), F.col(c))
    slots = pool.select(*match, F.col(KEY).alias("control_entity"), "control_id")
    slots = slots.withColumn("place", F.row_number().over(own.orderBy(order("control_entity"), "control_entity", order("control_id"), "control_id")) - 1)
    sizes = slots.groupBy(*match).agg(F.count("*").alias("m_all"))
    same = slots.groupBy(*match, F.col("control_entity").alias(KEY)).agg(F.min("place").alias("own_at"), F.count("*").alias("own_n"))
    asked = cases.select("case_id", KEY, *match).join(sizes, match)
    if exclude_same:
        asked = asked.join(same, [*match, KEY], "left")
    else:
        asked = asked.withColumns({"own_at": F.lit(None).cast("int"), "own_n": F.lit(None).cast("long")})
    skip = F.coalesce("own_n", F.lit(0))
    asked = asked.withColumn("m", F.col("m_all") - skip).where("m > 0")
    asked = asked.withColumn("try", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("m")).cast("int") - 1)))
    at = F.pmod(F.pmod(order("case_id"), F.col("m")) + F.col("try") * F.pmod(F.lit(STRIDE), F.col("m")), F.col("m"))
    asked = asked.withColumn("at", at).withColumn("place", F.when(F.col("at") >= F.coalesce("own_at", F.col("m_all")), F.col("at") + skip).otherwise(F.col("at")))
    return asked.join(slots, [*match, "place"]).select("case_id", "control_id", "control_entity", *match)


def delisted_shares(cases: DataFrame, controls: DataFrame) -> DataFrame:
    """One row: the share of delisted names among the cases and among their controls (both with is_delisted)."""
    share = lambda rows, name: rows.agg(F.avg(F.col("is_delisted").cast("int")).alias(name))
    return share(cases, "delisted_share_cases").join(F.broadcast(share(controls, "delisted_share_controls")), F.lit(True))


def control_diagnostics(cases: DataFrame, pool: DataFrame, match: list[str]) -> DataFrame:
    """One row: mean and least pool size of the cases, without their own entity, and how many have none."""
    sizes = pool.groupBy(*match).agg(F.count("*").alias("all"))
    same = pool.groupBy(*match, KEY).agg(F.count("*").alias("own"))
    per = cases.join(sizes, match, "left").join(same, [*match, KEY], "left")
    left = F.coalesce("all", F.lit(0)) - F.coalesce("own", F.lit(0))
    return per.agg(F.avg(left).alias("mean_effective_pool"), F.min(left).alias("min_effective_pool"), F.count_if(left == 0).alias("n_empty"), F.lit(len(match)).alias("n_match_cols"))


def stop_outcomes(bars: DataFrame, target: float = 0.20, stop: float = 0.08, horizon: int = 60) -> DataFrame:
    """Every bar as an entry: the first close at or below -stop, else at or above target; else a timeout.

    The closes ahead are one window list; the first hit is found by folding functions, so nothing is joined.
    """
    ahead = F.collect_list("close").over(series().rowsBetween(1, horizon))
    rows = bars.select(KEY, "date", "close", (F.row_number().over(series()) - 1).alias("bar_idx"), ahead.alias("ahead"))
    returns = F.transform("ahead", lambda x: x / F.col("close") - 1)
    rows = rows.withColumn("r", returns).withColumn("hit", F.array_position(F.transform("r", lambda x: (x <= -stop) | (x >= target)), True))
    n = F.size("ahead")
    last = F.when(F.col("hit") > 0, F.col("hit")).otherwise(n).cast("int")
    result = F.when(n == 0, F.lit(0.0)).otherwise(F.get("r", last - 1))
    kind = F.when(F.col("hit") == 0, "timeout").when(result <= -stop, "loss").otherwise("win")
    return rows.select(KEY, "date", "bar_idx", kind.alias("outcome"), last.alias("bars"), result.alias("exit_return"))


def breakout_entries(bars: DataFrame, moves: DataFrame, lookback: int = 20) -> DataFrame:
    """Bars after a move's start, up to its peak, that close at a new high of up to lookback bars and above the day before."""
    rows = bars.select(KEY, "date", "close", (F.row_number().over(series()) - 1).alias("bar_idx"), F.max("close").over(trailing(lookback - 1)).alias("top"), F.lag("close").over(series()).alias("before"))
    strong = rows.where((F.col("close") >= F.col("top")) & (F.col("close") > F.col("before")))
    m = moves.select(F.col(KEY).alias("m_id"), "scale", "trough_idx", "peak_idx")
    return strong.join(m, (F.col(KEY) == F.col("m_id")) & (F.col("bar_idx") > F.col("trough_idx")) & (F.col("bar_idx") <= F.col("peak_idx"))).select(KEY, "scale", "trough_idx", "date", "bar_idx")


def entry_expectancy(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """n, win rate, mean exit and mean win and loss of entries."""
    won = lambda v: F.when(F.col("outcome") == v, F.col("exit_return"))
    return outcomes.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("outcome") == "win").cast("int")).alias("win_rate"), F.avg("exit_return").alias("expectancy"), F.avg(won("win")).alias("avg_win"), F.avg(won("loss")).alias("avg_loss"))


def trough_vs_breakout(bars: DataFrame, moves: DataFrame, **policy) -> DataFrame:
    """Expectancy of entries at the troughs and at the breakouts of the same moves."""
    found = stop_outcomes(bars, **policy)
    troughs = moves.select(KEY, F.col("trough_idx").alias("bar_idx"), F.lit("trough").alias("entry"))
    breaks = breakout_entries(bars, moves).select(KEY, "bar_idx", F.lit("breakout").alias("entry"))
    return entry_expectancy(troughs.unionByName(breaks).join(found, [KEY, "bar_idx"]), ["entry"])


def population_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: Jaccard similarity of two sets of identities and how many are only in one."""
    names = a.columns
    both = a.distinct().withColumn("in_a", F.lit(1)).join(b.distinct().withColumn("in_b", F.lit(1)), names, "full")
    return both.agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("n_both"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), safe_div(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).cast("double"), F.count("*")).alias("jaccard"))


def near_events(events: DataFrame, others: DataFrame, days: int) -> DataFrame:
    """Events with another event of the same entity within so many calendar days either way."""
    o = others.select(F.col(KEY).alias("o_id"), F.col("event_date").alias("o_date"))
    return events.join(o, (F.col(KEY) == F.col("o_id")) & (F.col("o_date") >= F.date_sub("event_date", days)) & (F.col("o_date") <= F.date_add("event_date", days)), "left_semi")


def anchor_events(bars: DataFrame, rules: Rules = Rules(), families: str = "ABCDEF") -> DataFrame:
    """Entry events of every entity with their outcomes, in one grouped pass."""
    names = [x.split()[0] for x in EVENT.split(", ")[1:]]

    def run(s):
        p = Panel(s, rules)
        dates = s["date"].to_pylist()
        out = {n: [] for n in names}
        for b, family, tag, native in all_events(p, families) if p.n else ():
            kind, after, best, worst, stop = outcome(p, b, native)
            row = (dates[b], b, family, tag or None, float(p.c[b]), float(stop), float(native), kind, dates[b + after] if after else None, best, worst, after)
            for n, value in zip(names, row, strict=True):
                out[n].append(value)
        return out

    return per_entity(bars.select(KEY, "date", "open", "high", "low", "close", "volume"), run, EVENT)


def anchor_variants(bars: DataFrame, variants=VARIANTS) -> DataFrame:
    """Events under each changed threshold, named axis=value. Each variant is a lazy pass over the same bars."""
    out = None
    for axis, value in variants:
        found = anchor_events(bars, replace(Rules(), **{axis: value}), axis[0].upper() if axis[0] != "a" else "ACE").withColumn("variant", F.lit(f"{axis}={value}"))
        out = found if out is None else out.unionByName(found)
    return out


def alternative_labels(bars: DataFrame, labels: dict = LABELS, families: str = "ABCDEF") -> DataFrame:
    """The same events under other targets, stops and horizons, named by rule."""
    out = None
    for name, changed in labels.items():
        found = anchor_events(bars, replace(Rules(), **changed), families).withColumn("rule", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def walkforward_folds(points: DataFrame, bounds: list[tuple[int, int]], k: int, embargo: int, t: str = "t") -> DataFrame:
    """Rows by fold and role: train if the label ends before the test starts, less the embargo; test if its label is complete.

    bounds lists (test start, test end); there are as many copies of a row as folds that use it.
    """
    last = max(e for _, e in bounds)
    roles = [F.when((F.col(t) + k < s) & (F.col(t) < s - embargo), "train").when((F.col(t) >= s) & (F.col(t) < e) & (F.col(t) + k < last), "test") for s, e in bounds]
    folds = F.array(*(F.struct(F.lit(n).alias("fold"), r.alias("role")) for n, r in enumerate(roles)))
    return points.select("*", F.inline(folds)).where("role IS NOT NULL")


def disjoint_folds(rows: DataFrame, n: int) -> DataFrame:
    """Folds by entity: the rank of the entity modulo n. Ranks come from the distinct ids alone."""
    ids = rows.select(KEY).distinct()
    ranked = ids.select(KEY, ((F.row_number().over(Window.orderBy(KEY)) - 1) % n).alias("fold"))
    return rows.join(ranked, KEY)


def rewind_points(cases: DataFrame, offsets: tuple[int, ...] = (0, 5, 21, 63)) -> DataFrame:
    """Each case and control (entity_id, bar_idx, label) read so many bars before; those without that many bars go."""
    at = cases.withColumn("offset", F.explode(F.array(*(F.lit(o) for o in offsets)))).withColumn("bar_idx", F.col("bar_idx") - F.col("offset"))
    return at.where("bar_idx >= 0")


def first_hit(flag: Column, value: Column, ahead: int) -> Column:
    """The value at the first flagged bar from here to ahead bars on."""
    return F.first(F.when(flag, value), ignorenulls=True).over(series().rowsBetween(0, ahead))
