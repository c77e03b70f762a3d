"""Clustered inference, effect sizes, multiple testing, neutralisation, lifts and bootstraps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from panelspark.functions import special
from panelspark.functions.windows import safe_div
from panelspark.scratch import in_order, materialise


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([special.student_p(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df, strict=True)], dtype="float64")


def long_form(matrix: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """One row for each known value: keep, feature, x."""
    rows = matrix.unpivot(keep, features, "feature", "x")
    return rows.where(F.col("x").isNotNull() & ~F.isnan("x"))


def cluster_robust(rows: DataFrame, by: str = "feature", x: str = "x", g: str = "g", cluster: str = "entity_id") -> DataFrame:
    """coef, se, t, df and p of x regressed on g with errors clustered: one aggregation to fit, one to sum scores.

    Null where fewer than two clusters, no variation in g, or no residual degree of freedom remains.
    """
    s = lambda e: F.sum(e)
    gx, gg = F.col(g) * F.col(x), F.col(g) * F.col(g)
    # Sums by cluster first: all that follows is over clusters, and a large cluster is summed map-side.
    per = rows.groupBy(by, cluster).agg(F.count("*").alias("n"), s(g).alias("sg"), s(gg).alias("sgg"), s(x).alias("sx"), s(gx).alias("sgx"))
    tot = per.groupBy(F.col(by).alias("t_by")).agg(F.sum("n").alias("all_n"), F.count("*").alias("all_k"), *(F.sum(c).alias(f"T{c}") for c in ("sg", "sgg", "sx", "sgx")))
    det = F.col("all_n") * F.col("Tsgg") - F.col("Tsg") * F.col("Tsg")
    slope = safe_div(F.col("all_n") * F.col("Tsgx") - F.col("Tsg") * F.col("Tsx"), det)
    tot = tot.withColumns({"det": det, "slope": slope}).withColumn("icpt", safe_div(F.col("Tsx") - F.col("slope") * F.col("Tsg"), F.col("all_n")))
    both = per.join(tot, F.col(by) == F.col("t_by"))
    u = F.col("sx") - F.col("icpt") * F.col("n") - F.col("slope") * F.col("sg")
    v = F.col("sgx") - F.col("icpt") * F.col("sg") - F.col("slope") * F.col("sgg")
    out = both.withColumns({"u": u, "v": v}).groupBy(by).agg(*(F.first(c).alias(c) for c in ("all_n", "all_k", "det", "slope", "Tsg")), s(F.col("u") * F.col("u")).alias("uu"), s(F.col("u") * F.col("v")).alias("uv"), s(F.col("v") * F.col("v")).alias("vv"))
    # The (1, 1) entry of inverse * meat * inverse, whose second row is (-Sg, N) / det.
    a, b = -F.col("Tsg"), F.col("all_n")
    var = safe_div(a * a * F.col("uu") + 2 * a * b * F.col("uv") + b * b * F.col("vv"), F.col("det") * F.col("det"))
    small = safe_div(F.col("all_k"), F.col("all_k") - 1) * safe_div(F.col("all_n") - 1, F.col("all_n") - 2)
    ok = (F.col("all_k") >= 2) & (F.col("all_n") > 2)
    out = out.withColumn("se", F.when(ok & (var * small > 0), F.sqrt(var * small)))
    out = out.withColumn("t", safe_div(F.col("slope"), F.col("se"))).withColumn("df", (F.col("all_k") - 1).cast("double"))
    return out.select(by, F.col("all_n").alias("n"), F.col("all_k").alias("n_clusters"), F.col("slope").alias("coef"), "se", "t", "df").withColumn("pvalue", student_p("t", "df"))


def effect_sizes(rows: DataFrame, by: str = "feature") -> DataFrame:
    """n_setup, n_control, Cohen's d, rank-biserial and Kolmogorov-Smirnov distance of x between g = 1 and g = 0.

    Values are first counted (feature, x), so equal values and large data meet map-side; ranks run over distinct values.
    """
    counted = rows.groupBy(by, "x").agg(F.sum("g").alias("c1"), F.sum(1 - F.col("g")).alias("c0"))
    order = Window.partitionBy(by).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(by)
    ranked = counted.withColumns({"u1": F.sum("c1").over(order), "u0": F.sum("c0").over(order), "n1": F.sum("c1").over(every), "n0": F.sum("c0").over(every)})
    below = F.col("u0") - F.col("c0")
    stats = ranked.groupBy(by).agg(
        F.first("n1").alias("n1"), F.first("n0").alias("n0"), F.sum(F.col("c1") * (below + F.col("c0") / 2.0)).alias("wins"),
        F.max(F.abs(safe_div(F.col("u1").cast("double"), F.col("n1")) - safe_div(F.col("u0").cast("double"), F.col("n0")))).alias("ks_stat"),
    )
    mom = rows.groupBy(F.col(by).alias("m_by")).agg(*(f(F.when(F.col("g") == k, F.col("x"))).alias(f"{n}{k}") for n, f in (("m", F.avg), ("s", F.var_samp)) for k in (1, 0)))
    both = stats.join(mom, F.col(by) == F.col("m_by"))
    pooled = F.sqrt(safe_div((F.col("n1") - 1) * F.col("s1") + (F.col("n0") - 1) * F.col("s0"), F.col("n1") + F.col("n0") - 2))
    d = F.when((F.col("n1") >= 2) & (F.col("n0") >= 2), safe_div(F.col("m1") - F.col("m0"), pooled))
    return both.select(by, F.col("n1").cast("long").alias("n_setup"), F.col("n0").cast("long").alias("n_control"), d.alias("cohens_d"), (1 - 2 * safe_div(F.col("wins"), F.col("n1") * F.col("n0"))).alias("rank_biserial"), "ks_stat")


def benjamini_hochberg(tests: DataFrame, p: str = "pvalue", alpha: float = 0.05, within: list[str] | None = None) -> DataFrame:
    """Adds qvalue and significant; null p-values are no tests.

    Equal p-values share a q-value, so distinct ones are counted, dealt to tasks by ranges of their order and written down.
    A range ranks its values from the counts of the ranges before it, and takes their least p * m / rank from those behind.
    """
    groups = [f"b_{k}" for k in range(len(within or []))]
    keys = [*(F.col(c).alias(g) for c, g in zip(within or [], groups, strict=True)), F.col(p).alias("b_p")]
    counted = tests.where(F.col(p).isNotNull()).groupBy(*keys).agg(F.count("*").alias("b_n"))
    rows = counted.repartitionByRange(*groups, "b_p").withColumn("b_part", F.spark_partition_id())
    rows = materialise(rows, "pvalues")
    # One row for each range and group; a group's ranges follow one another.
    ranges = Window.partitionBy(*groups, F.lit(0)).orderBy("b_part")
    back = Window.partitionBy(*groups, F.lit(0)).orderBy(F.col("b_part").desc())
    every = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    others = Window.unboundedPreceding, -1
    so_far = Window.unboundedPreceding, Window.currentRow
    same = lambda a, b: [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)]
    place, other = ["b_part", *groups], ["s_part", *(f"s_{g}" for g in groups)]
    named = lambda df: df.withColumnsRenamed(dict(zip(place, other, strict=True)))
    sums = rows.groupBy(*place).agg(F.sum("b_n").alias("b_sum"))
    sums = sums.withColumns({"b_before": F.coalesce(F.sum("b_sum").over(ranges.rowsBetween(*others)), F.lit(0)), "b_m": F.sum("b_sum").over(every)}).drop("b_sum")
    inside = Window.partitionBy(*place)
    rank = F.col("b_before") + F.sum("b_n").over(inside.orderBy("b_p").rowsBetween(*so_far))
    rows = rows.join(named(sums), same(place, other)).drop(*other).withColumn("b_raw", F.col("b_p") * F.col("b_m") / rank)
    least = rows.groupBy(*place).agg(F.min("b_raw").alias("b_least"))
    least = least.withColumn("b_behind", F.min("b_least").over(back.rowsBetween(*others))).drop("b_least")
    # From the greatest down: a frame that ends with the row grows by one row a step, one that begins with it is read anew.
    tail = F.min("b_raw").over(inside.orderBy(F.col("b_p").desc()).rowsBetween(*so_far))
    found = rows.withColumn("b_tail", tail).join(named(least), same(place, other))
    found = found.select(*groups, "b_p", F.least(F.lit(1.0), "b_tail", "b_behind").alias("qvalue"))
    out = tests.join(found, [*same(within or [], groups), F.col(p) == F.col("b_p")], "left").drop(*groups, "b_p")
    return out.withColumn("significant", F.coalesce(F.col("qvalue") <= alpha, F.lit(False)))


def hierarchical_fdr(tests: DataFrame, family: str = "family", p: str = "pvalue", alpha: float = 0.05) -> DataFrame:
    """Families by Simes and BH; members of the families that stay by BH at alpha * selected / families."""
    w = Window.partitionBy(family).orderBy(p)
    known = tests.where(F.col(p).isNotNull())
    simes = known.withColumn("_s", F.col(p) * F.count("*").over(Window.partitionBy(family)) / F.row_number().over(w)).groupBy(family).agg(F.min("_s").alias("family_p"))
    families = benjamini_hochberg(simes, "family_p", alpha).select(family, "family_p", F.col("significant").alias("family_significant"))
    level = families.agg((F.lit(alpha) * F.count_if("family_significant") / F.count("*")).alias("alpha_member"))
    rows = benjamini_hochberg(tests, p, alpha, [family]).drop("significant").join(families, family, "left").join(F.broadcast(level), F.lit(True))
    rejected = F.coalesce(F.col("family_significant") & (F.col("qvalue") <= F.col("alpha_member")), F.lit(False))
    return rows.withColumn("qvalue", F.when(F.col("family_significant"), F.col("qvalue"))).withColumn("rejected", rejected)


def univariate_screen(matrix: DataFrame, features: list[str], label: str = "label", cluster: str | None = "entity_id", alpha: float = 0.05) -> DataFrame:
    """One row a feature: clustered test, effect sizes, q-value. Without clusters it fails: dependence makes plain p-values lie."""
    if cluster is None:
        raise ValueError("a screen needs cluster ids")
    # Four aggregates read these rows; what made them runs once.
    rows = materialise(long_form(matrix.withColumn("g", F.col(label).cast("int").cast("double")), features, [cluster, "g"]), "screen")
    tested = cluster_robust(rows, cluster=cluster).select("feature", "coef", "se", "t", "pvalue")
    both = effect_sizes(rows).join(tested, "feature", "left")
    enough = (F.col("n_setup") >= 3) & (F.col("n_control") >= 3)
    both = both.withColumns({c: F.when(enough, F.col(c)) for c in ("coef", "se", "t", "pvalue", "cohens_d", "rank_biserial", "ks_stat")})
    return benjamini_hochberg(both, "pvalue", alpha)


def average_rank(column: str, within: list) -> Column:
    """Ranks from 1, ties at their mean."""
    w = Window.partitionBy(*within)
    return F.rank().over(w.orderBy(column)) + (F.count("*").over(Window.partitionBy(*within, F.col(column))) - 1) / 2.0


def information_coefficient(rows: DataFrame, by: str, feature: str, target: str, method: str = "spearman") -> DataFrame:
    """n, ic and t of feature against target in each group."""
    rows = rows.where(F.col(feature).isNotNull() & F.col(target).isNotNull())
    if method == "spearman":
        rows = rows.withColumns({"_f": average_rank(feature, [by]), "_t": average_rank(target, [by])})
    else:
        rows = rows.withColumns({"_f": F.col(feature), "_t": F.col(target)})
    spread = F.stddev_pop("_f") * F.stddev_pop("_t")
    out = rows.groupBy(by).agg(F.count("*").alias("n"), (F.covar_pop("_f", "_t") / F.when(spread > 0, spread)).alias("ic"))
    t = F.col("ic") * F.sqrt((F.col("n") - 2) / F.when(F.abs("ic") < 1, 1 - F.col("ic") * F.col("ic")))
    return out.where("n >= 3").withColumn("tstat", t)


def decay_curve(points: DataFrame, bars: DataFrame, feature: str, target: str, horizons: tuple[int, ...] = (0, 5, 10, 20, 30)) -> DataFrame:
    """The coefficient of the feature read so many bars before each point."""
    at = points.withColumn("horizon_days", F.explode(F.array(*(F.lit(h) for h in horizons)))).withColumn("f_idx", F.col("bar_idx") - F.col("horizon_days"))
    f = bars.select(F.col("entity_id").alias("f_id"), F.col("bar_idx").alias("f_bar"), F.col(feature).alias("f_value"))
    rows = at.join(f, (F.col("entity_id") == F.col("f_id")) & (F.col("f_idx") == F.col("f_bar")))
    return information_coefficient(rows, "horizon_days", "f_value", target)


def factor_neutralize(rows: DataFrame, feature: str, factor: str, date: str = "date") -> DataFrame:
    """Residual of the feature on one factor within each date; too few rows, or a constant factor, leave the mean taken off."""
    w = Window.partitionBy(date)
    both = F.col(feature).isNotNull() & F.col(factor).isNotNull()
    rows = rows.where(both)
    n, mf, mx = F.count("*").over(w), F.avg(feature).over(w), F.avg(factor).over(w)
    var = F.var_pop(factor).over(w)
    beta = F.covar_pop(feature, factor).over(w) / F.when(var > 1e-18, var)
    residual = F.col(feature) - mf - F.when(n > 2, F.coalesce(beta, F.lit(0.0))).otherwise(0.0) * (F.col(factor) - mx)
    return rows.withColumn("residual", residual)


def factors_neutralize(rows: DataFrame, feature: str, factors: list[str], date: str = "date") -> DataFrame:
    """Residual on several factors: a least-squares fit for each date, whose rows are one cross-section."""
    schema = rows.select("*").schema.add("residual", "double")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[feature].to_numpy(float)
        x = np.column_stack([np.ones(len(y)), pdf[factors].to_numpy(float)])
        fitted = x @ np.linalg.lstsq(x, y, rcond=None)[0] if len(y) > x.shape[1] else np.full(len(y), y.mean())
        return pdf.assign(residual=y - fitted)

    return rows.where(" AND ".join(f"{c} IS NOT NULL" for c in [feature, *factors])).groupBy(date).applyInPandas(fit, schema)


def industry_neutralize(rows: DataFrame, feature: str, industry: str = "sector", date: str | None = "date") -> DataFrame:
    cell = Window.partitionBy(*([date] if date else []), industry)
    return rows.withColumn("residual", F.col(feature) - F.avg(feature).over(cell))


def whole_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the rank of column over all rows, ties at their mean: values are counted, and running sums of the counts rank them."""
    counted = rows.groupBy(F.col(column).alias("w_value")).agg(F.count("*").alias("w_n"))
    placed = in_order(counted, [F.col("w_value")], F.col("w_n"), "w_before")
    placed = placed.select("w_value", (F.col("w_before") + (F.col("w_n") + 1) / 2.0).alias(name))
    return rows.join(placed, F.col(column).eqNullSafe(F.col("w_value"))).drop("w_value")


def effect_retention(rows: DataFrame, raw: str, residual: str, target: str) -> DataFrame:
    """One row: the share of the rank correlation with target that the residual keeps."""

    def strength(feature: str, name: str) -> DataFrame:
        known = rows.where(F.col(raw).isNotNull() & F.col(feature).isNotNull() & F.col(target).isNotNull()).select(F.col(feature).alias("e_f"), F.col(target).alias("e_t"))
        ranked = whole_rank(whole_rank(known, "e_f", "e_a"), "e_t", "e_b")
        spread = F.stddev_pop("e_a") * F.stddev_pop("e_b")
        return ranked.agg(F.count("*").alias("n"), F.abs(F.covar_pop("e_a", "e_b") / F.when(spread > 0, spread)).alias(name)).where("n >= 3").drop("n")

    both = strength(raw, "raw_ic").join(F.broadcast(strength(residual, "residual_ic")), F.lit(True))
    return both.withColumn("retention", safe_div(F.col("residual_ic"), F.col("raw_ic")))


def correlation_matrix(matrix: DataFrame, features: list[str], pairwise: bool = False) -> np.ndarray:
    """Pearson correlations from one aggregation: features squared numbers, whatever the rows. Over rows that know all
    features, or, pairwise, over the rows that know both of a pair. NaN where a side does not vary."""
    rows = matrix.select(*(F.col(f).cast("double").alias(f) for f in features))
    known = lambda f: F.col(f).isNotNull() & ~F.isnan(f)
    rows = rows.select(*(F.when(known(f), F.col(f)).alias(f) for f in features))
    if not pairwise:
        rows = rows.dropna()
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1, len(features))]

    def corr(a: str, b: str):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        return F.covar_pop(a, b) / F.when(spread > 0, spread)

    got = rows.agg(*(F.stddev_pop(f) for f in features), *(corr(features[i], features[j]) for i, j in pairs)).first()
    out = np.diag([1.0 if sd else np.nan for sd in got[: len(features)]])
    for (i, j), c in zip(pairs, got[len(features) :], strict=True):
        out[i, j] = out[j, i] = np.nan if c is None else c
    return out


def variance_inflation(matrix: DataFrame, features: list[str]) -> DataFrame:
    """VIF of each feature, at least 1, from one inverse of the correlations over complete rows; a pseudo-inverse where they are
    singular; infinite for constants and beyond 1e10."""
    corr = correlation_matrix(matrix, features)
    fine = np.isfinite(np.diag(corr))
    vif = np.where(fine, 1.0, np.inf)
    if fine.sum() > 1:
        part = corr[np.ix_(fine, fine)]
        try:
            inverse = np.diag(np.linalg.inv(part))
        except np.linalg.LinAlgError:
            inverse = np.diag(np.linalg.pinv(part))
        vif[fine] = np.where(np.isfinite(inverse) & (inverse <= 1e10), np.maximum(1.0, inverse), np.inf)
    return matrix.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, vif, strict=True)], "feature string, vif double")


def high_correlation_pairs(matrix: DataFrame, features: list[str], least: float = 0.9) -> DataFrame:
    """Pairs of features whose correlation, over the rows that know both, reaches least in size."""
    corr = correlation_matrix(matrix, features, pairwise=True)
    found = [(features[i], features[j], float(corr[i, j])) for i in range(len(features)) for j in range(i + 1, len(features)) if abs(corr[i, j]) >= least]
    found.sort(key=lambda r: -abs(r[2]))
    return matrix.sparkSession.createDataFrame(found, "feature_a string, feature_b string, corr double")


def deciles(score: str, within: list, n: int = 10, tie: str = "point_id") -> Column:
    w = Window.partitionBy(*within)
    return F.floor((F.row_number().over(w.orderBy(score, tie)) - 1) * n / F.count("*").over(w)).cast("int")


def decile_lift(rows: DataFrame, score: str, forward: str, n: int = 10, date: str | None = None, tie: str = "point_id") -> DataFrame:
    """decile, mean and hit rate: pooled, or formed within each date of at least n rows and averaged over dates."""
    rows = rows.where(F.col(score).isNotNull() & F.col(forward).isNotNull())
    hit = (F.col(forward) > 0).cast("int")
    if date is None:
        placed = in_order(rows, [F.col(score), F.col(tie)], name="_place", total="_all")
        return placed.withColumn("decile", F.floor(F.col("_place") * n / F.col("_all")).cast("int")).groupBy("decile").agg(F.avg(forward).alias("mean"), F.avg(hit).alias("hit_rate"), F.count("*").alias("n"))
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(date))).where(F.col("_n") >= n).withColumn("decile", deciles(score, [date], n, tie))
    per = rows.groupBy(date, "decile").agg(F.avg(forward).alias("m"), F.avg(hit).alias("h"), F.count("*").alias("c"))
    return per.groupBy("decile").agg(F.avg("m").alias("mean"), F.avg("h").alias("hit_rate"), F.sum("c").alias("n"))


def capacity(rows: DataFrame, score: str, adv: str, top: float = 0.1, clip: float = 0.01, tie: str = "point_id") -> DataFrame:
    """One row: names in the top share, their median volume, a clip's median and the sum of clips."""
    placed = in_order(rows, [F.col(score), F.col(tie)], name="_place", total="_all", descending=True)
    best = placed.where(F.col("_place") < F.greatest(F.lit(1), F.floor(F.col("_all") * top)))
    return best.agg(F.count("*").alias("n_top"), F.percentile(adv, 0.5).alias("median_adv"), F.percentile(F.col(adv) * clip, 0.5).alias("median_clip"), F.sum(F.col(adv) * clip).alias("aggregate_capacity"))


def reliability(rows: DataFrame, predicted: str, label: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(predicted) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.avg(predicted).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("frac_positive"), F.count("*").alias("n"))


def auc(rows: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area under the curve by the rank sum, ties at mean ranks; values are counted first, so ranks run over distinct ones."""
    keys = by or []
    y = F.col(label).cast("int")
    counted = rows.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(y).alias("c1"), F.sum(1 - y).alias("c0"))
    if keys:
        w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
        ranked = counted.withColumn("below", F.coalesce(F.sum("c0").over(w), F.lit(0)))
    else:
        ranked = in_order(counted, [F.col(score)], F.col("c0"), "below")
    return ranked.groupBy(*keys).agg(safe_div(F.sum(F.col("c1") * (F.col("below") + F.col("c0") / 2.0)), F.sum("c1") * F.sum("c0")).alias("auc"))


def classify_findings(findings: DataFrame, consistency: float = 0.70, worst_auc: float = 0.45, retention: float = 0.50, require_pretrough: bool = True) -> DataFrame:
    """Tier 1: predictive in walk-forward, survives both neutralisations, actionable; tier 2: survives; tier 3: the rest."""
    forward = (F.col("wf_consistency") >= consistency) & (F.col("worst_fold_auc") >= worst_auc)
    neutral = (F.col("factor_retention") >= retention) & (F.col("industry_retention") >= retention) & F.col("significant_after")
    act = F.col("pretrough_actionable") if require_pretrough else F.lit(True)
    return findings.withColumn("tier", F.when(forward & neutral & act, 1).when(neutral, 2).otherwise(3))


def expected_max_sharpe(n_trials: int, sr_std: float = 1.0) -> float:
    if n_trials < 2:
        return 0.0
    a, b = special.normal_quantile(1 - 1 / n_trials), special.normal_quantile(1 - 1 / (n_trials * np.e))
    return sr_std * ((1 - special.EULER) * a + special.EULER * b)


def effective_n(n: float, autocorr: float) -> float:
    rho = min(0.99, max(-0.99, autocorr))
    return max(1.0, n * (1 - rho) / (1 + rho))


def deflated_sharpe(observed: float, n_obs: float, n_trials: int, sr_std: float, skew: float = 0.0, kurt: float = 3.0, autocorr: float = 0.0) -> float:
    """Probability that the Sharpe ratio beats the best of n_trials by chance; kurt is not excess."""
    scale = np.sqrt(max(1e-12, 1 - skew * observed + (kurt - 1) / 4 * observed**2))
    return special.normal_cdf((observed - expected_max_sharpe(n_trials, sr_std)) * np.sqrt(max(1.0, effective_n(n_obs, autocorr) - 1)) / scale)


def deflated_sharpe_tracked(returns: DataFrame, trials: list[float], column: str = "ret", order: str = "date") -> dict[str, float]:
    """All inputs derived: moments and lag-1 correlation of the returns by one aggregation, the rest from the trials recorded."""
    if len(trials) < 2:
        raise ValueError("at least two recorded trials are needed")
    rows = returns.select(F.col(column).alias("r"), F.lag(column).over(Window.orderBy(order)).alias("r1"))
    spread = F.stddev_pop(F.when(F.col("r1").isNotNull(), F.col("r"))) * F.stddev_pop("r1")
    g = rows.agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_pop("r").alias("s"), F.skewness("r").alias("k3"), (F.kurtosis("r") + 3).alias("k4"), safe_div(F.covar_pop("r", "r1"), spread).alias("ac")).first()
    sharpe = g["m"] / g["s"] if g["s"] else 0.0
    p = deflated_sharpe(sharpe, g["n"], len(trials), float(np.std(trials, ddof=1)), g["k3"] or 0.0, g["k4"] or 3.0, g["ac"] or 0.0)
    return {"n_obs": g["n"], "sharpe": sharpe, "skew": g["k3"], "kurt": g["k4"], "autocorr": g["ac"], "deflated": p}


#: Blocks that clusters are dealt to in a bootstrap; the driver holds draws times so many counts and sums.
BOOTSTRAP_BLOCKS = 128


def multiplier_bootstrap(rows: DataFrame, values: list[str], cluster: str = "entity_id", draws: int = 500, seed: int = 0, level: float = 0.95) -> DataFrame:
    """value, mean, low and high: the mean of each column over all rows that know it, and its interval over resampled clusters.

    A draw takes as many clusters as there are, with replacement, and weighs all columns by the same counts. How many of a
    draw fall to each block of clusters is drawn first, then how often each cluster of the block: together one multinomial
    draw. Only sums by cluster enter, and sums by block and draw come back, to be added in a fixed order.
    """
    spark = rows.sparkSession
    sums = [f(F.col(v)).cast("double").alias(f"{n}{k}") for k, v in enumerate(values) for n, f in (("s", F.sum), ("n", F.count))]
    per = rows.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("c_id")).agg(*sums)
    per = materialise(per.withColumn("block", F.pmod(F.xxhash64("c_id"), F.lit(BOOTSTRAP_BLOCKS)).cast("int")), "clusters")
    sizes = {r["block"]: r["n"] for r in per.groupBy("block").agg(F.count("*").alias("n")).collect()}
    schema = "value string, mean double, low double, high double"
    if not sizes:
        return spark.createDataFrame([(v, None, None, None) for v in values], schema)
    blocks, total = sorted(sizes), sum(sizes.values())
    counts = np.random.default_rng(seed).multinomial(total, [sizes[b] / total for b in blocks], size=draws)
    place, names = {b: k for k, b in enumerate(blocks)}, [f"{n}{k}" for k in range(len(values)) for n in "sn"]

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c_id", kind="stable")
        b = int(pdf["block"].iloc[0])
        rng, share = np.random.default_rng([seed, b]), np.full(len(pdf), 1.0 / len(pdf))
        x = pdf[names].fillna(0.0).to_numpy(float)
        drawn = np.stack([rng.multinomial(int(n), share) @ x for n in counts[:, place[b]]])
        whole = pd.DataFrame(np.vstack([x.sum(axis=0), drawn]), columns=names)
        return whole.assign(block=b, draw=np.arange(-1, draws))

    found = per.groupBy("block").applyInPandas(weigh, ", ".join([*(f"{n} double" for n in names), "block int", "draw int"])).toPandas().sort_values(["draw", "block"])
    every = found.groupby("draw", sort=True)[names].sum()
    out, tail = [], (1 - level) / 2
    for k, v in enumerate(values):
        n = every[f"n{k}"].to_numpy()
        mean = np.divide(every[f"s{k}"].to_numpy(), n, out=np.full(len(n), np.nan), where=n > 0)
        low, high = (np.nanquantile(mean[1:], q) if np.isfinite(mean[1:]).any() else np.nan for q in (tail, 1 - tail))
        out.append((v, *(float(x) if np.isfinite(x) else None for x in (mean[0], low, high))))
    return spark.createDataFrame(out, schema)


def block_bootstrap(rows: DataFrame, value: str, cluster: str = "entity_id", draws: int = 500, seed: int = 0, level: float = 0.95) -> DataFrame:
    """One row: the mean of value over all rows and its interval over resampled clusters."""
    return multiplier_bootstrap(rows, [value], cluster, draws, seed, level).drop("value")


def feature_mutual_info(matrix: DataFrame, features: list[str], label: str, bins: int = 16) -> DataFrame:
    """Mutual information of each feature's quantile bin with the label, in nats (a binned estimate)."""
    rows = long_form(matrix.withColumn("y", F.col(label).cast("int")), features, ["y"])
    edges = rows.groupBy(F.col("feature").alias("e")).agg(F.percentile_approx("x", [k / bins for k in range(1, bins)], 10_000).alias("cuts"))
    b = rows.join(F.broadcast(edges), F.col("feature") == F.col("e")).withColumn("b", F.size(F.filter("cuts", lambda c: c < F.col("x"))))
    cells = b.groupBy("feature", "b", "y").agg(F.count("*").alias("n"))
    w = lambda *c: Window.partitionBy("feature", *c)
    p = F.col("n") / F.sum("n").over(w())
    joint = cells.withColumn("term", p * F.log(F.col("n") * F.sum("n").over(w()) / (F.sum("n").over(w("b")) * F.sum("n").over(w("y")))))
    return joint.groupBy("feature").agg(F.sum("term").alias("mutual_info"))


def pretrough_actionable(points: DataFrame, bars: DataFrame, feature: str, target: str, cluster: str = "entity_id", horizons: tuple[int, ...] = (5, 10, 20, 30), alpha: float = 0.05) -> bool:
    """Whether the feature, read at every required horizon before the point, still regresses on the target with clustered significance."""
    at = points.withColumn("horizon_days", F.explode(F.array(*(F.lit(h) for h in horizons)))).withColumn("f_idx", F.col("bar_idx") - F.col("horizon_days"))
    f = bars.select(F.col("entity_id").alias("f_id"), F.col("bar_idx").alias("f_bar"), F.col(feature).alias("f_value"))
    rows = at.join(f, (F.col("entity_id") == F.col("f_id")) & (F.col("f_idx") == F.col("f_bar"))).where(F.col("f_value").isNotNull() & F.col(target).isNotNull())
    ranked = rows.select("horizon_days", cluster, average_rank("f_value", ["horizon_days"]).alias("g"), average_rank(target, ["horizon_days"]).alias("x"))
    tested = cluster_robust(ranked, "horizon_days", cluster=cluster)
    return tested.where(F.col("pvalue") < alpha).count() == len(horizons)


def regime_collinearity(matrix: DataFrame, features: list[str], regime: str, least: float = 0.9) -> DataFrame:
    """feature and corr for features that nearly repeat the regime score."""
    rows = long_form(matrix.where(F.col(regime).isNotNull()), features, [regime])
    spread = F.stddev_pop("x") * F.stddev_pop(regime)
    out = rows.groupBy("feature").agg(F.count("*").alias("n"), (F.covar_pop("x", regime) / F.when(spread > 0, spread)).alias("corr"))
    return out.where((F.col("n") >= 3) & (F.abs("corr") >= least)).select("feature", "corr")


def score_band(scores: list[float], level: float = 0.95) -> dict[str, float]:
    """Interpolated quantiles and mean of null scores."""
    tail = (1 - level) / 2
    return {"lo": float(np.quantile(scores, tail)), "hi": float(np.quantile(scores, 1 - tail)), "mean": float(np.mean(scores))}


def control_verdicts(real: float, shuffled: dict, permuted: dict, shifted: float | None = None, chance: float = 0.5, tolerance: float = 0.05) -> dict[str, bool]:
    """leak_free, has_signal, cross_sectional_edge and passes, each its own verdict."""
    leak_free = shuffled["mean"] <= chance + tolerance and (shifted is None or shifted <= shuffled["hi"])
    has_signal = real > shuffled["hi"]
    return {"leak_free": leak_free, "has_signal": has_signal, "cross_sectional_edge": real > permuted["hi"], "passes": leak_free and has_signal}
