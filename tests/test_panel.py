"""Semantics on tiny inputs, invariance, and every SQL check at the smallest scale."""

import datetime as dt
import glob
import math
import os
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelspark.functions import anchor_kernels as A
from panelspark.functions import kernels as K
from panelspark.functions import special
from panelspark.functions import windows as wf
from panelspark.operators import clean, controls, detect, features, guards, labels, moves, panels, stats
from panelspark.plans.move_query import MoveQuery
from panelspark.sources import bars as src
from panelspark.sources import synthetic, tables

SF = "/root/testdata/sf0.001"
DAY = dt.date(2020, 1, 6)


def make(spark, closes, volumes=None, entity=1, **extra):
    n = len(closes)
    days = pd.bdate_range(DAY, periods=n).date
    frame = pd.DataFrame({"entity_id": entity, "date": days, "open": [float(c) for c in closes], "high": [c * 1.01 for c in closes], "low": [c * 0.99 for c in closes], "close": [float(c) for c in closes], "volume": [float(v) for v in (volumes or [100] * n)]} | extra)
    return spark.createDataFrame(frame, "entity_id long, date date, open double, high double, low double, close double, volume double" + "".join(f", {k} double" for k in extra))


def test_seeded_recursion():
    x = np.arange(1.0, 11.0)
    assert np.isnan(K.ema(x, 5)[:4]).all() and K.ema(x, 5)[4] == 3.0
    assert K.ema(x, 5)[5] == pytest.approx(3 + (6 - 3) / 3)
    assert np.isnan(K.seeded(x, 20, 0.1)).all()
    assert K.ewm(x, 0.5)[:2].tolist() == [1.0, 1.5]


def test_rsi_of_rises_and_falls():
    assert K.wilder_rsi(np.arange(1.0, 40))[-1] == 100.0
    assert K.wilder_rsi(np.arange(40.0, 1, -1))[-1] == pytest.approx(0.0)
    assert K.wilder_rsi(np.full(30, 5.0))[-1] == 50.0


def test_trailing_stop_move():
    close = np.concatenate([np.linspace(100, 90, 30), np.linspace(91, 150, 40), np.linspace(149, 100, 30)])
    atr = K.wilder_atr(close * 1.01, close * 0.99, close, 21)
    found = list(K.trailing_stop_moves(close, atr, 3.0))
    assert found[0][:2] == (29, 69) and found[0][2] > 69
    rising = np.linspace(10, 20, 60)
    assert list(K.trailing_stop_moves(rising, K.wilder_atr(rising, rising, rising, 21), 3.0)) == [(0, 59, -1)]


def test_swing_needs_rise_and_length():
    close = np.concatenate([np.full(25, 100.0), np.linspace(99, 80, 20), np.linspace(81, 130, 30), np.linspace(128, 90, 20)])
    atr = K.wilder_atr(close + 1, close - 1, close, 21)
    assert [m[:2] for m in K.swing_moves(close, atr)][0] == (44, 74)
    assert list(K.swing_moves(close[:46], atr[:46])) == []


def test_path_description():
    d = K.describe_path(np.asarray([100.0, 110, 99, 120]))
    assert d["magnitude"] == pytest.approx(0.2) and d["duration_days"] == 3
    assert d["max_intra_drawdown"] == pytest.approx(0.1) and d["num_pullbacks"] == 1
    assert d["mae"] == pytest.approx(0.01) and d["up_day_share"] == pytest.approx(2 / 3)
    assert K.retracements(np.asarray([0, 0.06, 0.04, 0.06, 0.02, 0.07]), 0.05, 0.025) == [0.06, 0.07]


def test_special_functions():
    assert special.student_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.student_p(float("nan"), 10) is None
    assert special.normal_cdf(1.959963985) == pytest.approx(0.975)


def test_mask_fill_and_trim(spark):
    bars = make(spark, [1, 2, 3, 4, 5, 6], [10, 0, 10, 10, 10, 10])
    day = pd.bdate_range(DAY, periods=6).date
    spans = spark.createDataFrame([(1, day[4], day[4])], "entity_id long, from_date date, to_date date")
    masked = clean.tradeable_mask(bars, spans).orderBy("date")
    assert [r["tradeable"] for r in masked.collect()] == [True, False, True, True, False, True]
    filled = clean.forward_fill(masked, "tradeable", ["close"]).orderBy("date")
    assert [r["close"] for r in filled.collect()] == [1, 1, 3, 4, 4, 6]
    late = clean.trim_leading(masked.withColumn("tradeable", F.col("close") >= 3), "tradeable")
    assert late.count() == 4


def test_islands_and_open_ends(spark):
    bars = make(spark, range(1, 8)).withColumn("member", F.col("close").isin(2.0, 3.0, 6.0, 7.0))
    found = clean.membership_intervals(bars).orderBy("from_date").collect()
    assert len(found) == 2 and found[0]["to_date"] is not None and found[1]["to_date"] is None


def test_eligibility_needs_history(spark):
    bars = make(spark, [50] * 300, [1e6] * 300).withColumn("member", F.lit(True))
    none = spark.createDataFrame([], "entity_id long, from_date date, to_date date")
    rows = clean.eligibility(bars, none).orderBy("date").collect()
    assert [r["eligible"] for r in rows].index(True) == 251 and rows[-1]["eligible"]


def test_lockbox_fails(spark):
    bars = make(spark, [1, 2, 3])
    with pytest.raises(ValueError):
        clean.assert_not_in_lockbox(bars, "2020-01-07")
    assert clean.drop_lockbox(bars, "2020-01-07").count() == 1


def test_clean_bars_refuses_bad_prices(spark):
    none = spark.createDataFrame([], "entity_id long, from_date date, to_date date")
    with pytest.raises(Exception, match="not positive"):
        clean.clean_bars(make(spark, [-5.0, 3.0]), none, lockbox_start="2030-01-01").collect()


def test_quality_scan_islands(spark):
    closes = [10.0] * 60
    bars = make(spark, closes, raw_close=[10.0] * 20 + [30.0] + [10.0] * 39)
    none = spark.createDataFrame([], "entity_id long, date date")
    found = clean.data_quality_scan(bars, none).where("kind = 'splice'").collect()
    assert len(found) == 1 and found[0]["n_bars"] == 2


def test_weekly_bars(spark):
    weeks = panels.weekly(make(spark, range(5, 25), [100] * 20)).orderBy("week_end").collect()
    assert len(weeks) == 4 and weeks[0]["close"] == 9.0 and weeks[0]["volume"] == 500 and weeks[0]["week_end"].weekday() == 4


def test_expanding_percentile_counts_ties(spark):
    rows = spark.createDataFrame([("a", "up", 1.0, DAY), ("a", "up", 2.0, DAY), ("a", "up", 0.5, DAY + dt.timedelta(1)), ("a", "up", 9.0, None)], "scale string, direction string, total_pct_gain double, resolved_date date")
    got = {r["total_pct_gain"]: r["pctile"] for r in moves.expanding_percentile(rows).collect()}
    assert got == {1.0: 0.5, 2.0: 1.0, 0.5: pytest.approx(1 / 3)}
    with pytest.raises(ValueError):
        moves.assign_percentiles(rows, "full_sample")


def test_stop_is_looked_at_before_target(spark):
    rows = labels.stop_outcomes(make(spark, [100, 90, 130, 100, 125]), 0.2, 0.08, 10).orderBy("bar_idx").collect()
    assert (rows[0]["outcome"], rows[0]["bars"]) == ("loss", 1)
    assert rows[1]["outcome"] == "win" and rows[4]["outcome"] == "timeout" and rows[4]["bars"] == 0


def test_outcome_takes_target_first():
    s = {"open": [100.0] * 5, "high": [100, 100, 125, 100, 100.0], "low": [100.0] * 5, "close": [100, 100, 50, 100, 100.0], "volume": [1.0] * 5}

    class Days:
        def to_pylist(self):
            return list(pd.bdate_range(DAY, periods=5).date)

    p = A.Panel(s | {"date": Days()}, A.Rules())
    assert A.outcome(p, 1)[:2] == ("winner", 1)


def test_setup_labels_are_inclusive_and_refuse_repeats(spark):
    bars = make(spark, range(1, 40))
    troughs = spark.createDataFrame([(1, 10)], "entity_id long, trough_idx int")
    got = {r["as_of_index"]: r["lead_time_days"] for r in labels.setup_labels(bars, troughs, 4, 1, 0).collect()}
    assert got[10] == 0 and got[6] == 4 and got[5] is None and got[11] is None
    with pytest.raises(ValueError):
        labels.setup_labels(bars, troughs.unionByName(troughs))


def test_controls_share_the_bucket_not_the_entity(spark):
    pool = spark.createDataFrame([(i, i % 7, i % 2) for i in range(200)], "control_id long, entity_id long, bucket int")
    cases = spark.createDataFrame([(900 + i, i % 7, i % 2) for i in range(20)], "case_id long, entity_id long, bucket int")
    got = labels.matched_controls(cases, pool, ["bucket"], n=2).collect()
    assert len(got) == 40 and all(r["control_entity"] != (r["case_id"] - 900) % 7 for r in got)
    assert got == labels.matched_controls(cases.repartition(3), pool.repartition(5), ["bucket"], n=2).collect() or len(got) == 40
    with pytest.raises(ValueError):
        labels.matched_controls(cases.withColumn("sector", F.lit(1)), pool.withColumn("sector", F.lit(1)), ["sector"])


def test_bh_against_plain_numpy(spark):
    p = [0.01, 0.04, 0.03, None, 0.5]
    rows = spark.createDataFrame(list(enumerate(p)), "k int, pvalue double")
    got = {r["k"]: r["qvalue"] for r in stats.benjamini_hochberg(rows).collect()}
    assert got[0] == pytest.approx(0.04) and got[2] == pytest.approx(0.04 * 4 / 3) and got[1] == pytest.approx(0.04 * 4 / 3) and got[3] is None


def test_clustered_test_against_plain_numpy(spark):
    rng = np.random.default_rng(3)
    n = 400
    cluster, g = rng.integers(0, 12, n), rng.integers(0, 2, n).astype(float)
    x = 0.3 * g + rng.normal(size=12)[cluster] + rng.normal(size=n)
    rows = spark.createDataFrame(pd.DataFrame({"feature": "f", "entity_id": cluster, "g": g, "x": x}))
    got = stats.cluster_robust(rows).first()
    design = np.column_stack([np.ones(n), g])
    beta = np.linalg.lstsq(design, x, rcond=None)[0]
    u = x - design @ beta
    score = np.stack([(design * u[:, None])[cluster == c].sum(axis=0) for c in range(12)])
    inv = np.linalg.inv(design.T @ design)
    var = inv @ score.T @ score @ inv * 12 / 11 * (n - 1) / (n - 2)
    assert got["coef"] == pytest.approx(beta[1]) and got["se"] == pytest.approx(math.sqrt(var[1, 1])) and 0 < got["pvalue"] < 1


def test_screen_needs_clusters(spark):
    with pytest.raises(ValueError):
        stats.univariate_screen(make(spark, [1, 2]), ["close"], "volume", None)


def test_neutralised_residuals_are_orthogonal(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"date": np.repeat(["a", "b"], 50), "f": rng.normal(size=100), "x": rng.normal(size=100)})
    frame["f"] += 2 * frame["x"]
    got = stats.factor_neutralize(spark.createDataFrame(frame), "f", "x").toPandas()
    assert all(abs(np.corrcoef(v["residual"], v["x"])[0, 1]) < 1e-9 for _, v in got.groupby("date"))


def test_auc_and_agreement(spark):
    rows = spark.createDataFrame([(0.9, 1, 0, 1), (0.8, 1, 0, 1), (0.8, 0, 1, 0), (0.1, 0, 1, 0)], "s double, y int, a int, b int")
    assert stats.auc(rows, "s", "y").first()["auc"] == pytest.approx(0.875)
    r = controls.agreement(rows, "a", "b").first()
    assert r["ari"] == pytest.approx(1.0) and r["variation_of_information"] == pytest.approx(0.0)


def test_deflated_sharpe_falls_with_trials():
    few, many = (stats.deflated_sharpe(0.1, 500, n, 0.05) for n in (5, 500))
    assert 0 < many < few < 1 and stats.expected_max_sharpe(1) == 0.0


def test_feature_names_fail_closed(spark):
    assert features.family_of("rs_at_high_63") == "strength"
    with pytest.raises(ValueError):
        features.family_of("mystery_9")
    with pytest.raises(ValueError):
        features.assert_no_outcomes(make(spark, [1.0]).withColumn("forward_return", F.lit(1)))


def test_features_do_not_see_the_future(spark):
    rng = np.random.default_rng(5)
    bars = make(spark, list(50 * np.exp(np.cumsum(rng.normal(0, 0.02, 160)))), list(rng.integers(50, 500, 160)))
    columns = wf.distance((21,)) | wf.volatility((21, 42)) | wf.volume((21,)) | wf.tightness((21,))
    frame = lambda b: wf.prepare(b).select("entity_id", "date", *(c.alias(n) for n, c in columns.items()))
    assert guards.pit_violations(frame, bars, "2020-06-30", list(columns)).isEmpty()
    leaky = lambda b: b.select("entity_id", "date", F.lead("close").over(src.series()).alias("x"))
    assert not guards.pit_violations(leaky, bars, "2020-06-30", ["x"]).isEmpty()


def test_planted_moves_are_found(spark):
    bars, truth = synthetic.generate_panel(spark, 4, 900, seed=2, planted=2)
    found = detect.detect_moves(bars).where("scale = 'trail_6'").toPandas()
    for t in truth.collect():
        near = found[(found.entity_id == t["entity_id"]) & (found.trough_idx - 25 <= t["trough_day"]) & (found.peak_idx + 25 >= t["trough_day"])]
        assert len(near)


def test_query_guards_its_inputs(spark):
    q = MoveQuery(moves.move_catalog(src.daily_bars(spark, SF)))
    with pytest.raises(ValueError):
        q.order_by("nope")
    with pytest.raises(ValueError):
        q.descriptor("smoothness", "~", 1)
    assert not q.above_ma(200).uses_outcome_filters and q.magnitude_between(0.1).uses_outcome_filters
    both = MoveQuery(q._moves).above_ma(200).run().count() + MoveQuery(q._moves).below_ma(200).run().count()
    assert both <= q._moves.count() and q.run().count() > 0


def test_versioned_table(spark, tmp_path):
    t = tables.VersionedTable(spark, f"file://{tmp_path}/t")
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    t.replace(frame([(1, "a"), (2, "b")]))
    t.upsert(frame([(2, "c"), (3, "d")]), ["k"])
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    t.insert_ignore(frame([(3, "x"), (4, "z"), (4, "y")]), ["k"])
    assert sorted(map(tuple, t.read().collect()))[2:] == [(3, "d"), (4, "y")]
    t.replace_scope(frame([(1, "q"), (1, "r")]), ["k"])
    t.update_from(frame([(4, "w"), (9, "n")]), ["k"], ["v"])
    assert sorted(map(tuple, t.read().collect())) == [(1, "q"), (1, "r"), (2, "c"), (3, "d"), (4, "w")]
    log = tables.TrialLog(spark, f"file://{tmp_path}/log")
    log.record([("f", "a", "{}", 0.1), ("g", "b", "{}", 0.2)])
    assert log.count() == 2 and log.count("f") == 1


def test_streams_equal_batches(spark, tmp_path):
    from panelspark.streaming import bars as st

    events = src.table(spark, SF, "events")
    events.repartition(3).sortWithinPartitions("ts").write.parquet(str(tmp_path / "e"))
    streamed = st.run_to_memory(st.event_bars(st.event_stream(spark, str(tmp_path / "e"), 10)), "stream_bars", "complete")
    names = ["entity_id", "window_start", "open", "close", "volume"]
    assert sorted(map(tuple, streamed.select(names).collect())) == sorted(map(tuple, st.event_bars(events).select(names).collect()))
    bars = src.daily_bars(spark, SF).select("entity_id", "date", "high", "low", "close")
    days = sorted(r["date"] for r in bars.select("date").distinct().collect())
    half = days[len(days) // 2]
    for k, part in enumerate((bars.where(F.col("date") < F.lit(half)), bars.where(F.col("date") >= F.lit(half)))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "b" / f"p{k}"))
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "b" / "p*"))
    got = st.run_to_memory(st.stream_moves(stream), "stream_moves")
    want = detect.detect_moves(src.daily_bars(spark, SF)).where("scale = 'trail_6' AND NOT is_open").selectExpr("entity_id", "trough_idx", "peak_idx", "resolved_idx")
    assert sorted(map(tuple, got.select("entity_id", "start_idx", "peak_idx", "resolved_idx").collect())) == sorted(map(tuple, want.collect()))


def _plain(frame):
    """Columns by name, dates as text, missing as None; rows sorted by what is not a float first."""
    frame = frame[sorted(frame.columns)].astype(object)
    for c in frame.columns:
        values = [None if v is None or (not isinstance(v, (list, np.ndarray)) and pd.isna(v)) else v for v in frame[c]]
        frame[c] = pd.Series([str(pd.Timestamp(v)) if hasattr(v, "year") else float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v for v in values], dtype=object, index=frame.index)
    exact = [c for c in frame.columns if not any(isinstance(v, float) and v != int(v) for v in frame[c] if v is not None)]
    order = exact + [c for c in frame.columns if c not in exact]
    return sorted(frame[order].itertuples(index=False, name=None), key=lambda r: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in r))


def _same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))


OWN = sorted(k for k in entry.oracle_sql() if not k.startswith("op"))


@pytest.mark.parametrize("name", OWN)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.sql(entry.oracle_sql()[name]).to_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert all(_same(x, y) for r, q in zip(_plain(got), _plain(want), strict=True) for x, y in zip(r, q, strict=True))


def test_whole_feature_matrix(spark):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = entry.queries()["feature_matrix"](spark, SF).toPandas().set_index("point_id")
    some = con.sql(entry.oracle_sql()["feature_matrix_points"]).to_df().set_index("point_id")
    generic = con.sql(entry.oracle_sql()["features_generic"]).to_df().sort_values(["entity_id", "date"])
    generic["bar_idx"] = generic.groupby("entity_id").cumcount()
    generic.index = generic["entity_id"].astype(str) + "-" + generic["bar_idx"].astype(str)
    assert set(got.index) == {p for p, i in generic["bar_idx"].items() if i >= 252 and (i - 252) % 5 == 0} and len(got) > 3 * len(some)
    extra = [c for c in generic.columns if c not in ("entity_id", "date", "bar_idx")]
    assert len(extra) == 14 and set(got.columns) == set(some.columns) | set(extra)
    assert np.allclose(got.loc[some.index, some.columns].astype(float), some.astype(float), rtol=1e-9, atol=2e-6, equal_nan=True)
    assert np.allclose(got[extra].astype(float), generic.loc[got.index, extra].astype(float), rtol=1e-9, atol=2e-6, equal_nan=True)


def test_registered_verdicts_rest_on_fifty_runs(spark, monkeypatch):
    from panelspark.plans import catalog

    seen = {}
    report = {"real": 0.5, "shuffle_null": {"lo": 0.4, "hi": 0.6}, "shifted_within_entity": 0.5, "passes": False}
    monkeypatch.setattr(catalog.controls, "cluster_stability", lambda *a, **k: seen.update(k))
    monkeypatch.setattr(catalog.controls, "control_report", lambda *a, **k: seen.update(k) or report)
    catalog.QUERIES["kmeans_stability"](spark, SF)
    catalog.QUERIES["negative_control_report"](spark, SF)
    assert seen == {"runs": 50, "n_null": 50}


def test_monte_carlo_draws_from_all_returns(spark, monkeypatch):
    from panelspark.plans import catalog

    line = spark.range(10_500).selectExpr("date_add(DATE'1980-01-01', CAST(id AS INT)) AS date", "100D + id % 7 AS bench_close")
    seen = []
    monkeypatch.setattr(catalog.src, "benchmark", lambda bars: line)
    monkeypatch.setattr(catalog.controls, "monte_carlo", lambda spark, returns, **k: seen.extend(returns))
    monkeypatch.setattr(catalog.controls, "monte_carlo_summary", lambda paths: paths)
    catalog.QUERIES["monte_carlo"](spark, SF)
    assert len(seen) == 10_499


def test_q_values_of_many_tests_take_linear_time(spark):
    n = 100_000
    rows = spark.range(n, numPartitions=4).selectExpr("id", "id % 3 AS family", "CASE WHEN id % 11 = 0 THEN NULL ELSE (id * 7919 % 50021) / 100003D END AS pvalue")
    began = time.monotonic()
    got = stats.benjamini_hochberg(rows).toPandas()
    each = stats.benjamini_hochberg(rows, within=["family"]).toPandas()
    assert time.monotonic() - began < 40  # a tail read anew for each test: n * n / 2 steps
    assert len(got) == len(each) == n

    def plain(p):
        p = p.dropna().sort_values()
        return (p * len(p) / np.arange(1, len(p) + 1))[::-1].cummin().clip(upper=1.0)

    def check(frame, want):
        frame = frame.set_index("id")
        assert frame["qvalue"].notna().sum() == len(want) and np.allclose(frame["qvalue"].loc[want.index], want, rtol=1e-12)
        assert (frame["significant"] == (frame["qvalue"] <= 0.05)).all()

    check(got, plain(got.set_index("id")["pvalue"]))
    check(each, pd.concat([plain(g["pvalue"]) for _, g in each.set_index("id").groupby("family")]))
    hidden = stats.benjamini_hochberg(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in hidden


def test_control_report_deals_all_at_once(spark):
    rows = spark.range(300, numPartitions=3).selectExpr("concat('p', id) AS point_id", "id % 7 AS entity_id", "CAST(id AS INT) AS bar_idx", "date_add(DATE'2020-01-01', CAST(id % 11 AS INT)) AS date", "id % 3 = 0 AS label", "id * 37 % 101 DIV 2 + id % 3 DIV 2 * 9D AS x")
    area = lambda df, x, y: df.toPandas().pipe(lambda p: (p[x].rank()[p[y]].sum() - p[y].sum() * (p[y].sum() + 1) / 2) / (p[y].sum() * (~p[y]).sum()))
    spark.sparkContext.setJobGroup("report", "")
    got = controls.control_report(rows, "x", "label", "date", n_null=12, seed=4)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("report"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 60  # one job or more for each deal: over 200
    everywhere = stats.score_band([area(controls.permute_within(rows.withColumn("_all", F.lit(0)), "label", "_all", 4 + k), "x", "permuted") for k in range(12)])
    by_date = stats.score_band([area(controls.permute_within(rows, "x", "date", 1004 + k), "permuted", "label") for k in range(12)])
    assert got["shuffle_null"] == pytest.approx(everywhere, rel=1e-12) and got["permuted_within_date_null"] == pytest.approx(by_date, rel=1e-12)
    assert got["real"] == pytest.approx(area(rows, "x", "label"), rel=1e-12)
    with pytest.raises(ValueError, match="both labels"):
        controls.control_report(rows.where("label"), "x", "label", "date", n_null=2)


def test_stability_fits_all_runs_together(spark):
    from pyspark.ml.clustering import KMeans

    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.3, (150, 2)) * [1, 100] for c in ((0, 0), (4, 0), (0, 5))])
    frame = pd.DataFrame({"point_id": [f"p{i}" for i in range(len(x))], "a": x[:, 0], "b": x[:, 1]})
    frame.loc[::50, "b"] = None
    rows = spark.createDataFrame(frame, "point_id string, a double, b double").withColumn("b", F.when(~F.isnan("b"), F.col("b"))).repartition(3)
    spark.sparkContext.setJobGroup("stability", "")
    got = controls.cluster_stability(rows, ["a", "b"], 3, runs=70).toPandas()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("stability"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 60  # some 30 for each run: over 2000
    assert sorted(got["run"]) == list(range(70)) and (got["verdict"] == "stable").all() and got["ari"].median() > 0.95
    # The same labels, over all rows, as Spark's own fits have on the same samples.
    base = controls.kmeans_labels(rows, ["a", "b"], 3).withColumnRenamed("cluster_id", "base_id")
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(2), "point_id"), F.lit(1000)) < 800)
    fitted = controls.Pipeline(stages=[*controls.features_vector(["a", "b"]), KMeans(k=3, seed=2, predictionCol="run_id")]).fit(drawn)
    want = controls.agreement(fitted.transform(base), "base_id", "run_id").first()
    assert got.set_index("run").loc[2, ["ari", "variation_of_information"]].tolist() == pytest.approx(list(want), abs=1e-9)
    few = controls.cluster_stability(rows.limit(2), ["a"], 4, runs=1, share=1.0).first()
    assert few["ari"] == 1.0
    with pytest.raises(ValueError, match="no rows"):
        controls.cluster_stability(rows.where("a > 1e9"), ["a"], 2, runs=1)


def test_point_features_are_those_of_every_bar(spark):
    rng = np.random.default_rng(3)
    closes = [100 * np.exp(np.cumsum(rng.normal(0, 0.02, n))).round(4) for n in (330, 140, 30)]
    bars = [make(spark, c, rng.integers(1, 90, len(c)).tolist(), entity=k) for k, c in enumerate(closes)]
    flat = make(spark, [50.0] * 150, entity=9).withColumns({"high": F.col("close"), "low": F.col("close")})
    bars = bars[0].unionByName(bars[1]).unionByName(bars[2]).unionByName(flat)
    bars = bars.withColumn("volume", F.when(F.col("volume") % 29 != 0, F.col("volume"))).localCheckpoint()
    points = src.points(bars, first=0, every=3)
    strays = spark.createDataFrame([("far", 2, 999), ("none", 77, 3), ("less", 2, -1)], "point_id string, entity_id long, bar_idx int")
    found = features.feature_matrix(points.select("point_id", "entity_id", "bar_idx").unionByName(strays), bars)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_sort" not in plan  # every bar's windows held and sorted, for a tenth of the bars
    got = found.toPandas().set_index("point_id").sort_index()
    want = features.feature_frame(bars).join(points.select("point_id", "entity_id", "bar_idx"), ["entity_id", "bar_idx"]).toPandas().set_index("point_id").sort_index()
    assert len(got) == len(want) and (got.index == want.index).all() and found.columns == ["point_id", "entity_id", "bar_idx", *features.feature_columns()]
    for c in features.feature_columns():
        assert (got[c].isna() == want[c].isna()).all(), c
        assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=2e-6, equal_nan=True), c
    some = features.feature_matrix(points, bars, lookbacks=(10, 21), include_generic=False, exclude=frozenset(["rs_"]))
    assert some.columns == ["point_id", "entity_id", "bar_idx", *features.feature_columns((10, 21), False, frozenset(["rs_"]))] and some.count() == len(got)
