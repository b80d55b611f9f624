"""Skew-safe ordered operators against plain windows, with tiny blocks so that edges are crossed often."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetspan.operators import ordered as W
from fleetspan.operators.quantiles import approx_quantiles, column_quantiles, exact_quantiles

EV = ["ts", "event_id"]


def pdf(df, key="event_id"):
    return df.orderBy(key).toPandas().reset_index(drop=True)


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows, many rows share a time, some values and keys are missing."""
    rows = []
    for i in range(400):
        key = "hot" if i % 4 else ("cold" if i % 8 else None)
        rows.append((i, key, dt.datetime(2024, 1, 1 + i // 100, (i // 10) % 24), None if i % 7 == 0 else float(i * 37 % 101), i % 3 == 0))
    return spark.createDataFrame(rows, "event_id long, k string, ts timestamp_ntz, v double, late boolean").repartition(5)


def test_history_matches_plain_windows(hot):
    got = pdf(W.history_features(hot, ["k"], EV, W.time_bucket("ts", 3600), "late", "v", rows=(5, 12), prefix="k", block=16))
    w = Window.partitionBy("k").orderBy(*EV)

    def roll(n):
        p = w.rowsBetween(-n, -1)
        return F.when(F.col("k").isNotNull() & (F.count("v").over(p) >= 3), F.avg("v").over(p))

    want = pdf(hot.withColumns({
        "n": F.when(F.col("k").isNotNull(), F.row_number().over(w) - 1),
        "r": F.when(F.col("k").isNotNull(), F.avg(F.col("late").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))),
        "a": roll(5), "b": roll(12)}))
    for g, x in (("k_prior_count", "n"), ("k_prior_rate", "r"), ("k_roll5_mean", "a"), ("k_roll12_mean", "b")):
        pd.testing.assert_series_equal(got[g].astype(float), want[x].astype(float), check_names=False)
    first = got[got.k_prior_count == 0]
    assert len(first) == 2 and first.k_prior_rate.isna().all() and first.k_roll5_mean.isna().all()


def test_lags_leads_runs_and_size(hot):
    rows = hot.where("k is not null")
    w = Window.partitionBy("k").orderBy(*EV)
    got = pdf(W.lags(rows, ["k"], EV, W.time_bucket("ts"), "v", (1, 2, 7), block=8))
    want = pdf(rows.withColumns({f"l{k}": F.lag("v", k).over(w) for k in (1, 2, 7)}))
    for k in (1, 2, 7):
        pd.testing.assert_series_equal(got[f"v_lag{k}"], want[f"l{k}"], check_names=False)
    led = W.lead_label(rows, ["k"], EV, W.time_bucket("ts"), "late", block=3)
    assert led.count() == rows.count() - 2
    tag = pdf(W.run_tag(rows, ["k"], EV, W.time_bucket("ts"), F.col("v") > 95, 4, block=5))
    plain = pdf(rows.withColumn("t", F.max((F.col("v") > 95).cast("int")).over(w.rowsBetween(-3, 0)) == 1))
    assert (tag.in_run.fillna(False).astype(bool) == plain.t.fillna(False).astype(bool)).all()
    ends = pdf(W.terminal_flag(rows, ["k"], EV, W.time_bucket("ts")))
    assert ends.is_terminal.sum() == 2 and set(ends.progress.agg(["min", "max"])) == {0.0, 1.0}


def test_runs_and_traces_are_bounded(hot):
    runs = W.cluster_runs(hot, ["k"], EV, W.time_bucket("ts"), 9)
    sizes = runs.groupBy("k", "run_no").count().toPandas()
    assert sizes["count"].max() == 9 and runs.agg(F.max("stop_sequence")).first()[0] == 9
    thin = W.thin_trace(hot, ["k"], EV, W.time_bucket("ts"), target=10).groupBy("k").count().toPandas()
    assert thin["count"].max() < 20


def test_ranks(spark, hot):
    got = pdf(W.pct_rank(hot, "v", parts=8))
    want = got.v.rank(pct=True).fillna(0.5)
    pd.testing.assert_series_equal(got.pct_rank, want, check_names=False)
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("a", 1.0), ("b", 9.0)], "g string, s double")
    ranks = W.dense_rank_in_group(df, ["g"], "s", -F.floor("s")).orderBy("g", "rank_in_group").collect()
    assert [(r.g, r.rank_in_group) for r in ranks] == [("a", 1), ("a", 1), ("a", 2), ("b", 1)]


def test_days_mean_excludes_the_same_instant(spark):
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    df = spark.createDataFrame([(1, "a", t(1), 1.0), (2, "a", t(1), 3.0), (3, "a", t(2), 5.0), (4, "a", t(4), 7.0), (5, "a", t(12), 9.0)], "event_id long, k string, ts timestamp_ntz, v double")
    out = pdf(W.rolling_days_mean(df, ["k"], "ts", "v", 7, min_rows=1)).rolling_days_mean
    assert out[0:2].isna().all() and out[2] == 2.0 and out[3] == 3.0 and pd.isna(out[4])


@pytest.mark.parametrize("values", [[1.0, 2.0, 4.0, 9.0, None], [5.0], [2.0] * 40 + [7.0], [float(i * i % 97) for i in range(500)]])
def test_quantiles_are_linear(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    qs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.885, "e": 1.0}
    row = exact_quantiles(df, [], "v", qs).first()
    s = pd.Series(values, dtype=float)
    for n, q in qs.items():
        assert row[n] == pytest.approx(s.quantile(q), abs=1e-12)


def test_quantiles_large_bracket_and_groups(spark):
    df = spark.range(200_000).select((F.col("id") % 2).alias("g"), (F.pmod(F.col("id") * 7919, F.lit(99_991)) / 7).alias("v"))
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"lo": 0.01, "m": 0.5, "hi": 0.999}).collect()}
    p = df.toPandas()
    for g, s in p.groupby("g").v:
        assert got[g].m == pytest.approx(s.quantile(0.5), abs=1e-9)
        assert got[g].lo == pytest.approx(s.quantile(0.01), abs=1e-9)
        assert got[g].hi == pytest.approx(s.quantile(0.999), abs=1e-9)
    near = approx_quantiles(df, ["g"], "v", {"m": 0.5}).where("g = 0").first().m
    assert abs(near - got[0].m) < 5


def test_quantiles_of_empty_frame(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert exact_quantiles(df, ["g"], "v", {"m": 0.5}).count() == 0
    two = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    assert [(r.column, r.m) for r in column_quantiles(two, ["a", "b"], {"m": 0.5}).collect()] == [("a", 2.0)]


def test_history_cuts_large_keys_and_moves_rows_once(hot):
    """Blocks of every size against the uncut window, flag and value given as columns; one shuffle of the rows."""
    late, v = F.col("late") & True, F.col("v") + 0

    def made(block, **k):
        return W.history_features(hot, ["k"], EV, W.time_bucket("ts", 3600), late, v, rows=(5, 12), prefix="k", block=block, **k)

    want = pdf(made(10_000))
    for block in (12, 40, 290):
        pd.testing.assert_frame_equal(pdf(made(block)), want)
        pd.testing.assert_frame_equal(pdf(made(block, sizes_from=hot.select("k"), totals_from=hot.drop("event_id"))), want)
    cut, _ = W.blocked(hot, ["k"], EV, W.time_bucket("ts", 3600), {}, 12, block=40)
    own = cut.where("_own")
    assert own.count() == hot.count() and own.where("k = 'hot'").select("_blk").distinct().count() > 4 and cut.count() > hot.count()
    plan = made(10_000, sizes_from=hot.select("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 3 and "Join" not in plan
