"""All queries over panels and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import udfs
from panelspark.functions import windows as wf
from panelspark.functions.anchor_kernels import Rules
from panelspark.operators import clean, controls, detect, features, labels, panels, pilot, stats
from panelspark.operators import moves as catalog_moves
from panelspark.plans import clean_sql, detect_sql, discovery_sql, features_sql, labels_sql, pilot_sql, streams_sql
from panelspark.plans.move_query import MoveQuery
from panelspark.scratch import materialise
from panelspark.sources import bars as src
from panelspark.sources import synthetic
from panelspark.sources.bars import KEY
from panelspark.streaming import bars as event_streams

QUERIES: dict = {}
ORACLES: dict = dict(features_sql.oracles())


def query(f):
    QUERIES[f.__name__] = f
    return f


def _of(rows: DataFrame, columns: dict) -> DataFrame:
    return rows.select(KEY, "date", *(c.alias(n) for n, c in columns.items()))


@query
def features_distance(spark, sf_dir):
    return _of(wf.prepare(src.daily_bars(spark, sf_dir)), wf.distance())


@query
def features_volatility(spark, sf_dir):
    return _of(wf.prepare(src.daily_bars(spark, sf_dir)), wf.volatility())


@query
def features_volume(spark, sf_dir):
    return _of(wf.prepare(src.daily_bars(spark, sf_dir)), wf.volume())


@query
def features_tightness(spark, sf_dir):
    return _of(wf.prepare(src.daily_bars(spark, sf_dir)), wf.tightness())


@query
def features_averages(spark, sf_dir):
    return _of(wf.prepare(src.daily_bars(spark, sf_dir)), wf.averages())


@query
def features_relative_strength(spark, sf_dir):
    return _of(features.with_benchmark(src.daily_bars(spark, sf_dir)), wf.relative_strength())


@query
def features_group_strength(spark, sf_dir):
    return _of(features.with_sectors(src.daily_bars(spark, sf_dir), src.dimensions(spark, sf_dir)), wf.group_strength())


@query
def features_generic(spark, sf_dir):
    return _of(wf.prepare_generic(wf.prepare(src.daily_bars(spark, sf_dir))), wf.generic())


@query
def benchmark_posture(spark, sf_dir):
    line = src.benchmark(src.daily_bars(spark, sf_dir)).select(F.lit(0).alias(KEY), "date", F.col("bench_close").alias("close"))
    line = line.withColumns({"i": F.row_number().over(src.series()) - 1, "pc": F.lag("close").over(src.series())})
    line = line.withColumn("r", F.when((F.col("pc") > 0) & (F.col("close") > 0), F.log(F.col("close") / F.col("pc"))))
    return line.select("date", *(c.alias(n) for n, c in wf.benchmark_posture().items()))


@query
def smoothed_series(spark, sf_dir):
    return detect.recursions(src.daily_bars(spark, sf_dir))


@query
def moves_mfe_multiscale(spark, sf_dir):
    return detect.detect_moves(src.daily_bars(spark, sf_dir)).select(KEY, "scale", "trail_atr", "direction", "trough_idx", "peak_idx", "resolved_idx", "start_date", "peak_date", "resolved_date", "is_open")


@query
def move_descriptors(spark, sf_dir):
    moves = detect.detect_moves(src.daily_bars(spark, sf_dir))
    rounded = [F.round(c, 6).alias(c) for c in ("magnitude", "log_magnitude", "mae", "max_intra_drawdown", "smoothness", "up_day_share")]
    return moves.select(KEY, "scale", "start_date", "duration_days", "big_day_count", *rounded)


@query
def moves_atr_swing(spark, sf_dir):
    return detect.detect_swings(src.daily_bars(spark, sf_dir)).select(KEY, "trough_idx", "peak_idx", "resolved_idx", "is_open", "trough_gain_pct")


@query
def move_query_top(spark, sf_dir):
    bars = src.daily_bars(spark, sf_dir)
    found = MoveQuery(catalog_moves.move_catalog(bars)).primary_scale_only().above_ma(200).magnitude_between(0.2).order_by("total_pct_gain").limit(50).run()
    return found.select(KEY, "start_date", "peak_date", "scale", F.round("total_pct_gain", 6).alias("total_pct_gain"))


ORACLES |= detect_sql.oracles()


def _plain_catalog(spark, sf_dir):
    moves = detect.detect_moves(src.daily_bars(spark, sf_dir))
    return moves.withColumn("total_pct_gain", F.col("magnitude")).withColumn("descriptors", F.struct("magnitude", "duration_days")).withColumn("inception", F.struct("magnitude"))


@query
def move_query_significant(spark, sf_dir):
    """Closed moves in the top tenth of all that had resolved by their own resolution."""
    found = MoveQuery(catalog_moves.with_percentile(_plain_catalog(spark, sf_dir))).significant_above(0.9).run()
    return found.select(KEY, "scale", "start_date", "pctile")


@query
def move_query_filters(spark, sf_dir):
    found = MoveQuery(_plain_catalog(spark, sf_dir)).scale("trail_6").direction("up").duration_between(5, 60).run()
    return found.select(KEY, "scale", "start_date", "duration_days")


ORACLES["move_query_filters"] = f"""WITH m AS ({ORACLES["moves_mfe_multiscale"]})
    SELECT entity_id, scale, start_date, CAST(peak_idx - trough_idx AS DOUBLE) AS duration_days FROM m
    WHERE scale = 'trail_6' AND direction = 'up' AND peak_idx - trough_idx BETWEEN 5 AND 60"""
ORACLES["catalog_fingerprint"] = f"""WITH m AS ({ORACLES["moves_mfe_multiscale"]})
    SELECT count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(sha256(concat_ws('|', CAST(entity_id AS VARCHAR), CAST(CAST(start_date AS DATE) AS VARCHAR), scale, 'mfe', direction)), 1, 15)) AS BIGINT)) AS VARCHAR) AS digest FROM m"""


# Cleaning and universe

LOCKBOX, FLOOR, INDEX_START = "2001-01-01", 40.0, "1996-06-01"


def _members(spark, sf_dir):
    bars = src.daily_bars(spark, sf_dir)
    days = src.member_days(spark, sf_dir, bars)
    return bars, days, clean.membership_intervals(days)


def _spans(days):
    """Excluded spans for the queries: membership runs of at least four bars of every third entity."""
    last = days.groupBy(KEY).agg(F.max("date").alias("last_date"))
    runs = clean.islands(days.where(F.col(KEY) % 3 == 0), F.col("member")).where("n_bars >= 4").join(last, KEY)
    return runs.select(KEY, "from_date", F.when(F.col("to_date") < F.col("last_date"), F.col("to_date")).alias("to_date"))


@query
def bars_daily(spark, sf_dir):
    return src.daily_bars(spark, sf_dir)


@query
def bars_weekly(spark, sf_dir):
    return panels.weekly(src.daily_bars(spark, sf_dir))


@query
def bench_close(spark, sf_dir):
    return src.benchmark(src.daily_bars(spark, sf_dir))


@query
def theme_composite(spark, sf_dir):
    weights = src.dimensions(spark, sf_dir).select(KEY, "sector", (1 + F.col(KEY) % 3).alias("weight"))
    return panels.theme_composite(src.daily_bars(spark, sf_dir), weights).select("sector", "date", F.round("composite", 6).alias("composite"))


@query
def tradeable_mask(spark, sf_dir):
    bars, days, _ = _members(spark, sf_dir)
    return clean.tradeable_mask(bars, _spans(days)).select(KEY, "date", "tradeable")


@query
def forward_fill(spark, sf_dir):
    bars, days, _ = _members(spark, sf_dir)
    filled = clean.forward_fill(clean.tradeable_mask(bars, _spans(days)), "tradeable", ["close", "high", "low"])
    return filled.select(KEY, "date", "tradeable", "close", "high", "low")


@query
def clean_bars(spark, sf_dir):
    bars, days, _ = _members(spark, sf_dir)
    return clean.clean_bars(src.adjusted_bars(bars), _spans(days), FLOOR, LOCKBOX).select(KEY, "date", "open", "high", "low", "close", "volume")


@query
def contiguous_spans(spark, sf_dir):
    return clean.islands(src.daily_bars(spark, sf_dir), F.col("close") < F.col("open"))


@query
def membership_intervals(spark, sf_dir):
    return _members(spark, sf_dir)[2]


@query
def closed_intervals(spark, sf_dir):
    bars, _, intervals = _members(spark, sf_dir)
    return clean.close_open_intervals(intervals, src.dimensions(spark, sf_dir), bars.groupBy(KEY).agg(F.max("date").alias("last_quoted")))


@query
def interval_membership(spark, sf_dir):
    bars, _, intervals = _members(spark, sf_dir)
    return clean.in_spans(bars, intervals, "is_member").select(KEY, "date", "is_member")


@query
def return_disagreement(spark, sf_dir):
    bars = src.daily_bars(spark, sf_dir)
    other = bars.where(F.dayofmonth("date") != 15).withColumn("close", F.col("close") * (1 + F.when(F.col("volume") > 40, 0.03).otherwise(0)))
    return clean.return_disagreement(bars, other)


@query
def data_quality_scan(spark, sf_dir):
    bars = src.adjusted_bars(src.daily_bars(spark, sf_dir))
    actions = bars.where((F.col(KEY) % 4 == 0) & (F.col("date") >= clean.day("1998-01-01"))).groupBy(KEY).agg(F.min("date").alias("date"))
    return clean.data_quality_scan(bars, actions)


@query
def eligibility(spark, sf_dir):
    _, days, _ = _members(spark, sf_dir)
    return clean.eligibility(days, _spans(days), LOCKBOX, INDEX_START, FLOOR)


@query
def lockbox_drop(spark, sf_dir):
    return clean.assert_not_in_lockbox(clean.drop_lockbox(src.daily_bars(spark, sf_dir), LOCKBOX), LOCKBOX).select(KEY, "date", "close")


@query
def adjustment_offenders(spark, sf_dir):
    bars = src.adjusted_bars(src.daily_bars(spark, sf_dir))
    stale = (F.col(KEY) % 5 == 0) & (F.col("date") >= clean.day("2001-06-01"))
    return clean.adjustment_offenders(bars.withColumn("adj_factor", F.when(~stale, F.col("adj_factor"))))


@query
def crosswalk(spark, sf_dir):
    entities = src.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(KEY), F.concat(F.lit("S."), "s_suppkey").alias("symbol"))
    tickers = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker_id"), F.concat(F.lit("S-"), "c_custkey").alias("symbol"), (F.col("c_acctbal") > 0).alias("active"))
    return clean.crosswalk(entities, tickers)


@query
def restatement(spark, sf_dir):
    return clean.restatement_incidence(src.daily_bars(spark, sf_dir), "close", "open")


@query
def knee_floor(spark, sf_dir):
    return clean.knee_floor(src.daily_bars(spark, sf_dir).groupBy(KEY).agg(F.avg("volume").alias("adv")), "adv")


@query
def true_range(spark, sf_dir):
    return src.daily_bars(spark, sf_dir).select(KEY, "date", wf.true_range().alias("tr"))


@query
def catalog_series_hash(spark, sf_dir):
    return catalog_moves.series_hash(src.daily_bars(spark, sf_dir))


ORACLES |= clean_sql.oracles()


# Labels, entries and events


def _primary(spark, sf_dir, scale="trail_6"):
    bars = src.daily_bars(spark, sf_dir)
    return bars, detect.detect_moves(bars).where(F.col("scale") == scale)


@query
def setup_labels(spark, sf_dir):
    bars, moves = _primary(spark, sf_dir)
    return labels.setup_labels(bars, moves.select(KEY, "trough_idx"))


@query
def liquidity_quintile(spark, sf_dir):
    return labels.liquidity_quintile(src.daily_bars(spark, sf_dir), "volume").select(KEY, "date", "size_bucket")


@query
def matched_controls(spark, sf_dir):
    bars, moves = _primary(spark, sf_dir)
    pool = labels.liquidity_quintile(bars, "volume").join(src.dimensions(spark, sf_dir).select(KEY, "is_delisted"), KEY).withColumn("control_id", F.xxhash64(KEY, "date"))
    cases = pool.join(moves.select(KEY, F.col("start_date").alias("date")), [KEY, "date"]).withColumn("case_id", F.col("control_id"))
    return labels.matched_controls(cases.select("case_id", KEY, "date", "size_bucket", "is_delisted"), pool.select("control_id", KEY, "date", "size_bucket", "is_delisted"), ["date", "size_bucket"], n=1)


@query
def control_diagnostics(spark, sf_dir):
    bars, moves = _primary(spark, sf_dir)
    pool = labels.liquidity_quintile(bars, "volume")
    cases = pool.join(moves.select(KEY, F.col("start_date").alias("date")), [KEY, "date"])
    return labels.control_diagnostics(cases, pool, ["date", "size_bucket"])


@query
def entry_stop_outcome(spark, sf_dir):
    return labels.stop_outcomes(src.daily_bars(spark, sf_dir))


@query
def forward_extremes(spark, sf_dir):
    return _of(src.daily_bars(spark, sf_dir), wf.forward_extremes(60))


@query
def breakout_entries(spark, sf_dir):
    return labels.breakout_entries(*_primary(spark, sf_dir)).select(KEY, "trough_idx", "date", "bar_idx")


@query
def trough_vs_breakout(spark, sf_dir):
    found = labels.trough_vs_breakout(*_primary(spark, sf_dir))
    return found.select("entry", "n", *(F.round(c, 6).alias(c) for c in ("win_rate", "expectancy", "avg_win", "avg_loss")))


@query
def population_overlap(spark, sf_dir):
    moves = detect.detect_moves(src.daily_bars(spark, sf_dir))
    starts = lambda s: moves.where(F.col("scale") == s).select(KEY, "start_date")
    return labels.population_overlap(starts("trail_2"), starts("trail_6"))


@query
def near_events(spark, sf_dir):
    moves = detect.detect_moves(src.daily_bars(spark, sf_dir)).withColumn("event_date", F.col("start_date"))
    return labels.near_events(moves.where("scale = 'trail_15'"), moves.where("scale = 'trail_2'"), 5).select(KEY, "event_date")


@query
def anchor_events(spark, sf_dir):
    return labels.anchor_events(src.daily_bars(spark, sf_dir))


@query
def anchor_events_v2(spark, sf_dir):
    return labels.anchor_events(src.daily_bars(spark, sf_dir), Rules(f_version=2), "F")


@query
def anchor_events_v3(spark, sf_dir):
    return labels.anchor_events(src.daily_bars(spark, sf_dir), Rules(f_version=3), "F")


@query
def anchor_family_a(spark, sf_dir):
    found = labels.anchor_events(src.daily_bars(spark, sf_dir), families="A")
    return found.select(KEY, "bar_idx", "event_date", "outcome", "bars_to_resolution", F.round("stop_price", 6).alias("stop_price"), F.round("fwd_mfe", 6).alias("fwd_mfe"), F.round("fwd_mae", 6).alias("fwd_mae"))


@query
def anchor_family_d(spark, sf_dir):
    return labels.anchor_events(src.daily_bars(spark, sf_dir), families="D").select(KEY, "bar_idx", "event_date", "native_stop")


@query
def anchor_family_e(spark, sf_dir):
    return labels.anchor_events(src.daily_bars(spark, sf_dir), families="E").select(KEY, "bar_idx", "event_date", "native_stop")


@query
def anchor_variants(spark, sf_dir):
    return labels.anchor_variants(src.daily_bars(spark, sf_dir), (("a_depth", 0.25), ("a_vol", 2.0), ("d_above", "high"), ("e_gap", 1.0))).groupBy("variant", "family").agg(F.count("*").alias("n"))


@query
def walkforward_folds(spark, sf_dir):
    points = src.points(src.daily_bars(spark, sf_dir)).select("point_id", F.col("bar_idx").alias("t"))
    return labels.walkforward_folds(points, [(300, 375), (375, 450), (450, 525)], 20, 10)


@query
def disjoint_folds(spark, sf_dir):
    return labels.disjoint_folds(src.points(src.daily_bars(spark, sf_dir)).select("point_id", KEY), 5).select("point_id", "fold")


# The catalog of moves


def _catalog(spark, sf_dir):
    return catalog_moves.move_catalog(src.daily_bars(spark, sf_dir))


@query
def move_inception(spark, sf_dir):
    frame = catalog_moves.inception_frame(src.daily_bars(spark, sf_dir))
    return frame.select(KEY, "trough_idx", *(F.round(c, 6).alias(c) for c in frame.columns if c.startswith("incept_")))


@query
def expanding_percentile(spark, sf_dir):
    moves = detect.detect_moves(src.daily_bars(spark, sf_dir)).withColumn("total_pct_gain", F.col("magnitude"))
    return catalog_moves.expanding_percentile(moves.select(KEY, "scale", "direction", "start_date", "resolved_date", "total_pct_gain")).select(KEY, "scale", "start_date", "pctile")


@query
def frozen_percentile(spark, sf_dir):
    moves = detect.detect_moves(src.daily_bars(spark, sf_dir)).withColumn("total_pct_gain", F.col("magnitude"))
    return catalog_moves.frozen_percentile(moves, "1998-01-01").select(KEY, "scale", "start_date", "pctile")


@query
def move_audits(spark, sf_dir):
    return catalog_moves.run_audits(_catalog(spark, sf_dir))


@query
def descriptor_coverage(spark, sf_dir):
    return catalog_moves.null_coverage(_catalog(spark, sf_dir), "descriptors")


@query
def catalog_fingerprint(spark, sf_dir):
    moves = detect.detect_moves(src.daily_bars(spark, sf_dir)).withColumn("detection_system", F.lit("mfe"))
    return catalog_moves.fingerprint(moves)


@query
def scale_profile(spark, sf_dir):
    moves = detect.detect_moves(src.daily_bars(spark, sf_dir))
    return catalog_moves.cluster_profile(moves, "scale", ["duration_days"])


@query
def move_query_oversold(spark, sf_dir):
    q = MoveQuery(_catalog(spark, sf_dir)).scale("trail_2").inception("incept_rsi_14", "<", 35.0).descriptor("duration_days", ">=", 5).date_range("1996-01-01", "2000-12-31")
    return q.run().select(KEY, "start_date", "peak_date")


ORACLES |= labels_sql.oracles()
ORACLES["move_query_significant"] = f"WITH e AS ({ORACLES['expanding_percentile']}) SELECT entity_id, scale, start_date, pctile FROM e WHERE pctile >= 0.9"


# Discovery, regimes, models

SAMPLE_FEATURES = list(discovery_sql.FEATURES)


def _frame(spark, sf_dir):
    """Bars with four features, a 50-bar volume, the 20-bar forward return and the year."""
    rows = wf.prepare(src.daily_bars(spark, sf_dir))
    columns = wf.distance((63,)) | wf.volume((21,))
    rows = rows.withColumns({f: columns[f] for f in SAMPLE_FEATURES} | {"adv_50": F.avg("volume").over(src.trailing(49)), "fwd": F.lead("close", 20).over(src.series()) / F.col("close") - 1, "year": F.year("date")})
    return rows.select(KEY, "date", F.col("i").alias("bar_idx"), *SAMPLE_FEATURES, "adv_50", "fwd", "year")


def _sample(spark, sf_dir):
    rows = _frame(spark, sf_dir).where((F.col("bar_idx") >= 252) & ((F.col("bar_idx") - 252) % 5 == 0))
    return rows.withColumn("point_id", F.concat_ws("-", KEY, "bar_idx"))


def _labelled(spark, sf_dir):
    bars, moves = _primary(spark, sf_dir, "trail_2")
    found = labels.setup_labels(bars, moves.select(KEY, "trough_idx")).select(KEY, F.col("as_of_index").alias("bar_idx"), "label")
    return _sample(spark, sf_dir).join(found, [KEY, "bar_idx"])


def _tests(spark, sf_dir):
    k = F.col("p_partkey")
    p = F.when(k % 11 == 0, None).otherwise((k * 7919 % 100003) / F.lit(100003.0) / (1 + 200 * (k % 7 == 3).cast("int")))
    return src.table(spark, sf_dir, "part").select(k.alias("test_id"), F.concat(F.lit("f"), k % 7).alias("family"), p.alias("pvalue"))


@query
def univariate_screen(spark, sf_dir):
    found = stats.univariate_screen(_labelled(spark, sf_dir), SAMPLE_FEATURES)
    return found.select("feature", "n_setup", "n_control", *(F.round(c, 6).alias(c) for c in ("coef", "se", "cohens_d", "rank_biserial", "ks_stat")), F.round("t", 5).alias("t"))


@query
def bh_fdr(spark, sf_dir):
    return stats.benjamini_hochberg(_tests(spark, sf_dir)).select("test_id", F.round("qvalue", 9).alias("qvalue"), "significant")


@query
def hierarchical_fdr(spark, sf_dir):
    return stats.hierarchical_fdr(_tests(spark, sf_dir)).select("test_id", "family", "family_significant", "rejected")


@query
def ic_by_year(spark, sf_dir):
    return stats.information_coefficient(_sample(spark, sf_dir), "year", "range_position_63", "fwd").select("year", "n", F.round("ic", 6).alias("ic"))


@query
def ic_decay(spark, sf_dir):
    found = stats.decay_curve(_sample(spark, sf_dir).select(KEY, "bar_idx", "fwd"), _frame(spark, sf_dir), "range_position_63", "fwd")
    return found.select("horizon_days", "n", F.round("ic", 6).alias("ic"))


@query
def factor_neutralize(spark, sf_dir):
    return stats.factor_neutralize(_frame(spark, sf_dir), "range_position_63", "vol_surge_21").select(KEY, "date", F.round("residual", 6).alias("residual"))


@query
def industry_neutralize(spark, sf_dir):
    rows = _frame(spark, sf_dir).join(src.dimensions(spark, sf_dir).select(KEY, "sector"), KEY).where("range_position_63 IS NOT NULL")
    return stats.industry_neutralize(rows, "range_position_63").select(KEY, "date", F.round("residual", 6).alias("residual"))


@query
def factors_neutralize(spark, sf_dir):
    rows = _frame(spark, sf_dir).select(KEY, "date", *SAMPLE_FEATURES)
    return stats.factors_neutralize(rows, "range_position_63", ["vol_surge_21", "updown_vol_21"]).select(KEY, "date", "residual")


@query
def effect_retention(spark, sf_dir):
    rows = stats.factor_neutralize(_frame(spark, sf_dir), "range_position_63", "vol_surge_21")
    found = stats.effect_retention(rows.withColumn("residual", F.round("residual", 9)), "range_position_63", "residual", "fwd")
    return found.select(F.round("raw_ic", 6).alias("raw_ic"), F.round("residual_ic", 6).alias("residual_ic"), F.round("retention", 5).alias("retention"))


@query
def correlation_pairs(spark, sf_dir):
    return stats.high_correlation_pairs(_sample(spark, sf_dir), SAMPLE_FEATURES, 0.1).withColumn("corr", F.round("corr", 6))


@query
def variance_inflation(spark, sf_dir):
    return stats.variance_inflation(_sample(spark, sf_dir), SAMPLE_FEATURES)


@query
def mutual_information(spark, sf_dir):
    return stats.feature_mutual_info(_labelled(spark, sf_dir), SAMPLE_FEATURES, "label")


@query
def decile_lift(spark, sf_dir):
    return stats.decile_lift(_sample(spark, sf_dir), "range_position_63", "fwd").select("decile", F.round("mean", 6).alias("mean"), F.round("hit_rate", 6).alias("hit_rate"), "n")


@query
def decile_lift_by_date(spark, sf_dir):
    return stats.decile_lift(_frame(spark, sf_dir), "range_position_63", "fwd", date="date", tie=KEY).select("decile", F.round("mean", 6).alias("mean"), F.round("hit_rate", 6).alias("hit_rate"), "n")


@query
def capacity(spark, sf_dir):
    found = stats.capacity(_sample(spark, sf_dir).where("range_position_63 IS NOT NULL"), "range_position_63", "adv_50")
    return found.select("n_top", F.round("median_adv", 6).alias("median_adv"), F.round("median_clip", 6).alias("median_clip"), F.round("aggregate_capacity", 4).alias("aggregate_capacity"))


@query
def reliability(spark, sf_dir):
    rows = src.table(spark, sf_dir, "labels").withColumn("p", F.col("doc_id") * 7919 % 1000 / F.lit(1000.0))
    return stats.reliability(rows, "p", "quality").select("bin", F.round("mean_predicted", 9).alias("mean_predicted"), "frac_positive", "n")


@query
def auc_by_year(spark, sf_dir):
    return stats.auc(_labelled(spark, sf_dir), "range_position_63", "label", ["year"]).select("year", F.round("auc", 9).alias("auc"))


@query
def classify_findings(spark, sf_dir):
    k = F.col("p_partkey")
    cents = lambda m, n=100: k * m % n / F.lit(100.0)
    rows = src.table(spark, sf_dir, "part").select(k.alias("finding_id"), cents(37).alias("wf_consistency"), (0.4 + cents(53, 30)).alias("worst_fold_auc"), cents(71).alias("factor_retention"), cents(91).alias("industry_retention"), (k % 3 > 0).alias("significant_after"), (k % 5 > 1).alias("pretrough_actionable"))
    return stats.classify_findings(rows).select("finding_id", "tier")


@query
def deflated_sharpe(spark, sf_dir):
    line = src.benchmark(src.daily_bars(spark, sf_dir))
    w = src.Window.orderBy("date")
    rows = line.select("date", (F.col("bench_close") / F.lag("bench_close").over(w) - 1).alias("ret")).where("ret IS NOT NULL")
    found = stats.deflated_sharpe_tracked(rows, [0.01, 0.02, 0.05, -0.01, 0.03])
    return spark.createDataFrame([tuple(map(float, found.values()))], ", ".join(f"{n} double" for n in found))


@query
def block_bootstrap(spark, sf_dir):
    return stats.block_bootstrap(_sample(spark, sf_dir).where("fwd IS NOT NULL"), "fwd")


@query
def breadth(spark, sf_dir):
    return panels.breadth(src.daily_bars(spark, sf_dir))


@query
def market_context(spark, sf_dir):
    bars, days, _ = _members(spark, sf_dir)
    return panels.market_context(bars, clean.tradeable_mask(bars, _spans(days)).withColumn("eligible", F.col("tradeable")))


@query
def regime_daily(spark, sf_dir):
    bars = src.daily_bars(spark, sf_dir)
    return panels.regime_daily(bars, src.benchmark(bars), None, require_eligible=False)


@query
def era_normalize(spark, sf_dir):
    found = panels.era_normalize(_sample(spark, sf_dir), ["range_position_63"], "year")
    return found.select("point_id", F.round("range_position_63", 6).alias("range_position_63"))


@query
def rs_vs_theme(spark, sf_dir):
    weights = src.dimensions(spark, sf_dir).select(KEY, "sector", (1 + F.col(KEY) % 3).alias("weight"))
    bars = src.daily_bars(spark, sf_dir)
    found = panels.rs_vs_theme(bars.join(weights.select(KEY, "sector"), KEY), panels.theme_composite(bars, weights))
    return found.select(KEY, "date", F.round("rs_vs_theme", 6).alias("rs_vs_theme"))


@query
def theme_moves(spark, sf_dir):
    weights = src.dimensions(spark, sf_dir).select(KEY, "sector", (1 + F.col(KEY) % 3).alias("weight"))
    line = panels.theme_composite(src.daily_bars(spark, sf_dir), weights).select(F.col("sector").cast("long").alias(KEY), "date", F.round("composite", 9).alias("close"))
    return detect.theme_moves(line).select(KEY, "scale", "start_date", "peak_date", F.round("magnitude", 6).alias("magnitude"))


@query
def shift_control(spark, sf_dir):
    return controls.roll_within(_sample(spark, sf_dir).select(KEY, "bar_idx", "fwd"), "fwd", 5).select(KEY, "bar_idx", "rolled")


@query
def cyclic_null(spark, sf_dir):
    return controls.cyclic_null(_sample(spark, sf_dir).select(KEY, "bar_idx", "fwd"), "fwd", 7).select(KEY, "bar_idx", "rolled")


@query
def permute_within_date(spark, sf_dir):
    return controls.permute_within(_sample(spark, sf_dir).select("point_id", "date", "fwd"), "fwd", "date", 3).select("point_id", "date", "permuted")


@query
def agreement(spark, sf_dir):
    rows = _sample(spark, sf_dir).where("range_position_63 IS NOT NULL AND vol_surge_21 IS NOT NULL")
    rows = rows.select(F.floor(4 * F.least(F.lit(0.999), "range_position_63")).alias("a"), F.floor(F.least(F.lit(3), "vol_surge_21")).alias("b"))
    return controls.agreement(rows, "a", "b").select(F.round("ari", 6).alias("ari"), F.round("variation_of_information", 6).alias("variation_of_information"))


def _folds(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("t", F.col("bar_idx"))
    return labels.walkforward_folds(rows, [(350, 425), (425, 500)], 20, 10)


@query
def bake_off(spark, sf_dir):
    return controls.bake_off(_folds(spark, sf_dir).cache(), SAMPLE_FEATURES)


@query
def calibrated_scores(spark, sf_dir):
    rows = _labelled(spark, sf_dir).where("range_position_63 IS NOT NULL")
    return stats.reliability(controls.calibrate(rows, "range_position_63", "label"), "calibrated", "label")


@query
def kmeans_stability(spark, sf_dir):
    return controls.cluster_stability(_sample(spark, sf_dir).dropna(subset=SAMPLE_FEATURES).select("point_id", *SAMPLE_FEATURES), SAMPLE_FEATURES, 4, runs=50)


@query
def era_transfer(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("era", F.when(F.col("year") < 1998, "early").when(F.col("year") < 2000, "middle").otherwise("late"))
    return controls.era_transfer(rows.select("point_id", "label", "era", *SAMPLE_FEATURES).cache(), SAMPLE_FEATURES)


@query
def monte_carlo(spark, sf_dir):
    line = src.benchmark(src.daily_bars(spark, sf_dir))
    rows = line.select((F.col("bench_close") / F.lag("bench_close").over(src.Window.orderBy("date")) - 1).alias("r"), "date").where("r IS NOT NULL").orderBy("date")
    return controls.monte_carlo_summary(controls.monte_carlo(spark, [x["r"] for x in rows.collect()], block=5))


ORACLES |= discovery_sql.oracles()


# Streams and sources


@query
def stream_bars_batch(spark, sf_dir):
    return event_streams.event_bars(src.table(spark, sf_dir, "events"))


@query
def sliding_bars(spark, sf_dir):
    return event_streams.event_bars(src.table(spark, sf_dir, "events"), "2 days", "1 day").groupBy("window_start").agg(F.count("*").alias("n_bars"), F.sum("volume").alias("n_events"))


@query
def event_sessions(spark, sf_dir):
    return event_streams.event_sessions(src.table(spark, sf_dir, "events"), "6 hours").select("entity_id", "session_start", F.col("volume").alias("n_events"))


@query
def event_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return src.table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count(k).alias("n"))


@query
def anchor_family_d_gapped(spark, sf_dir):
    return labels.anchor_events(src.gapped(src.daily_bars(spark, sf_dir)), families="D").select(KEY, "bar_idx", "event_date", "native_stop")


@query
def anchor_family_e_gapped(spark, sf_dir):
    return labels.anchor_events(src.gapped(src.daily_bars(spark, sf_dir)), families="E").select(KEY, "bar_idx", "event_date", "native_stop")


@query
def feature_matrix_points(spark, sf_dir):
    bars = materialise(src.daily_bars(spark, sf_dir), "bars")
    return features.feature_matrix(src.points(bars, every=20), bars, include_generic=False)


@query
def feature_matrix(spark, sf_dir):
    bars = materialise(src.daily_bars(spark, sf_dir), "bars")
    return features.feature_matrix(src.points(bars), bars)


ORACLES |= streams_sql.oracles()


# Pilot universe, robustness and exhibits


@query
def pilot_allocation(spark, sf_dir):
    dims = src.dimensions(spark, sf_dir)
    cells = dims.groupBy("region", "is_delisted").agg(F.count("*").alias("n"))
    return pilot.proportional_allocation(cells, dims.count() // 5, ["region", "is_delisted"])


@query
def pilot_sample(spark, sf_dir):
    dims = src.dimensions(spark, sf_dir)
    return pilot.stratified_sample(dims, ["region", "is_delisted"], dims.count() // 5)


@query
def reverse_splits(spark, sf_dir):
    bars = src.adjusted_bars(src.daily_bars(spark, sf_dir)).withColumn("adj_factor", 1 / F.col("adj_factor"))
    return pilot.reverse_splits(bars)


@query
def first_eligible_families(spark, sf_dir):
    bars, days, intervals = _members(spark, sf_dir)
    named = intervals.withColumn("index_name", F.when(F.col(KEY) % 3 == 0, "sp500").when(F.col(KEY) % 3 == 1, "sp600").otherwise("r2000"))
    eligible = bars.select(KEY, "date", (F.col("volume") > 100).alias("eligible"))
    found = pilot.first_eligible(eligible, named)
    return found.select(KEY, "first_date", pilot.index_family(F.col("indexes")).alias("family"), pilot.era(F.col("first_date")).alias("era"))


@query
def base_symbols(spark, sf_dir):
    symbol = F.concat(F.lit("S"), "s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "Q").otherwise(""), F.when(F.col("s_suppkey") % 2 == 0, "-200101").otherwise(""))
    rows = src.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(KEY), symbol.alias("symbol"), F.col("s_name").alias("name"))
    return rows.select(KEY, pilot.base_symbol(F.col("symbol")).alias("base"), pilot.bankrupt(F.col("symbol"), F.col("name")).alias("bankrupt"))


@query
def latest_bar(spark, sf_dir):
    return pilot.latest_per_key(src.daily_bars(spark, sf_dir).select(KEY, "date", "close"), KEY, "date")


@query
def alternative_labels(spark, sf_dir):
    return labels.alternative_labels(src.daily_bars(spark, sf_dir), families="A").groupBy("rule", "outcome").agg(F.count("*").alias("n"))


@query
def rewind_auc(spark, sf_dir):
    cases = _labelled(spark, sf_dir).select(KEY, "bar_idx", "label")
    rows = labels.rewind_points(cases).join(_frame(spark, sf_dir).select(KEY, "bar_idx", "range_position_63"), [KEY, "bar_idx"])
    return stats.auc(rows, "range_position_63", "label", ["offset"]).select("offset", F.round("auc", 9).alias("auc"))


@query
def detector_comparison(spark, sf_dir):
    bars = src.daily_bars(spark, sf_dir)
    both = detect.detect_moves(bars).select("scale", "magnitude").unionByName(detect.detect_swings(bars).select("scale", F.col("trough_gain_pct").alias("magnitude")))
    cut = lambda q: F.round(F.percentile("magnitude", q), 6)
    return both.groupBy("scale").agg(F.count("*").alias("n"), cut(0.1).alias("p10"), cut(0.5).alias("p50"), cut(0.9).alias("p90"), F.avg((F.col("magnitude") < 0.1).cast("int")).alias("share_small"))


@query
def downside_capture(spark, sf_dir):
    bars = src.daily_bars(spark, sf_dir)
    found = panels.downside_capture(bars.join(src.benchmark(bars), "date"))
    return found.select(KEY, "date", F.round("downside_capture", 6).alias("downside_capture"))


@query
def regime_collinearity(spark, sf_dir):
    return stats.regime_collinearity(_sample(spark, sf_dir), ["range_position_63", "vol_surge_21"], "dist_from_high_63", 0.1).select("feature", F.round("corr", 6).alias("corr"))


@query
def temporal_logit(spark, sf_dir):
    return spark.createDataFrame([(controls.temporal_logit_auc(_labelled(spark, sf_dir), SAMPLE_FEATURES),)], "auc double")


@query
def negative_control_report(spark, sf_dir):
    rows = _labelled(spark, sf_dir).where("range_position_63 IS NOT NULL").select("point_id", KEY, "bar_idx", "date", "label", "range_position_63")
    found = controls.control_report(rows, "range_position_63", "label", "date", n_null=50)
    return spark.createDataFrame([(found["real"], found["shuffle_null"]["lo"], found["shuffle_null"]["hi"], found["shifted_within_entity"], found["passes"])], "real double, null_lo double, null_hi double, shifted double, passes boolean")


@query
def cluster_representation(spark, sf_dir):
    rows = controls.kmeans_labels(_sample(spark, sf_dir).dropna(subset=SAMPLE_FEATURES).select("point_id", *SAMPLE_FEATURES).cache(), SAMPLE_FEATURES, 4)
    return controls.resolve_representation(rows, "cluster_id", SAMPLE_FEATURES)


@query
def synthetic_moves(spark, sf_dir):
    return detect.detect_moves(synthetic.generate_panel(spark, 8, 900, seed=2)[0]).groupBy("scale").agg(F.count("*").alias("n"))


@query
def sql_functions(spark, sf_dir):
    udfs.register(spark)
    bars = src.daily_bars(spark, sf_dir)
    wide = bars.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("date", "high", "low", "close"))).alias("b"))
    wide.select(KEY, F.col("b.high").alias("h"), F.col("b.low").alias("l"), F.col("b.close").alias("c")).createOrReplaceTempView("panelspark_series")
    return spark.sql("SELECT s.entity_id, m.start_idx AS trough_idx, m.peak_idx, m.resolved_idx FROM panelspark_series s, LATERAL detect_moves(s.h, s.l, s.c, 6.0D) m")


ORACLES |= pilot_sql.oracles()
