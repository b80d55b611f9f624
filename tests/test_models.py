from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetspan.operators import clustering as CL
from fleetspan.operators import explain as EX
from fleetspan.operators import forecast as FC
from fleetspan.operators import metrics as ME
from fleetspan.operators import models as MO
from fleetspan.operators import planning as PL
from fleetspan.operators import splits as SP
from fleetspan.plans import model_queries as MQ


def test_binary_metrics_by_hand(spark):
    y, p = [0, 0, 0, 0, 1, 1, 1, 1], [0, 0, 0, 1, 1, 1, 1, 0]
    m = ME.classification_metrics(spark.createDataFrame(list(zip(y, p)), "y int, p int"), "y", "p").first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == (0.75, 0.75, 0.75, 0.75)


def test_regression_metrics_by_hand(spark):
    m = ME.regression_metrics(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, 6.0)], "y double, p double"), "y", "p").first()
    assert (m.rmse, m.mae, m.max_error, m.median_ae) == (1.0, 0.5, 2.0, 0.0)


def test_auc_with_ties_and_perfect_order(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.5), (1, 0.5), (1, 0.9)], "y int, s double")
    assert ME.roc_auc(df, "y", "s").first()[0] == 0.875
    assert ME.average_precision(df, "y", "s").first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    perfect = spark.createDataFrame([(0, 0.1), (1, 0.9)], "y int, s double")
    assert ME.roc_auc(perfect, "y", "s").first()[0] == 1.0
    one_class = spark.createDataFrame([(1, 0.1)], "y int, s double")
    assert ME.roc_auc(one_class, "y", "s").first()[0] is None


def test_last_calibration_bin_holds_one(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.95), (0, 0.0)], "y int, s double")
    assert sorted((r.bin, r.n) for r in ME.calibration_table(df, "y", "s").collect()) == [(0, 1), (9, 2)]


def test_temporal_split_counts_and_order(spark):
    df = spark.range(997).select("id", F.timestamp_add("HOUR", (F.col("id") * 31 % 997).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"))
    s = SP.temporal_split(df, "ts", ["id"]).persist()
    n = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert n == {"test": 199, "val": 99, "train": 699}
    assert all(r.after_train for r in SP.leak_report(s, "ts").collect())


@pytest.fixture(scope="module")
def prepared(spark):
    df = spark.range(3000).select(
        F.col("id"), ((F.col("id") * 7919 % 1000) / 1000.0).alias("a"), ((F.col("id") * 104729 % 1000) / 1000.0).alias("b"), F.when(F.col("id") % 3 != 0, (F.col("id") % 4).cast("string")).alias("c"))
    df = df.withColumn("label", (F.col("a") + F.col("b") * 0.2 > 0.6).cast("double")).withColumn("a", F.when(F.col("id") % 50 != 0, F.col("a")))
    df = SP.random_split(df.fillna({"c": "none"}), "id")
    pre = MO.fit_preprocessor(df.where("split = 'train'"), ["a", "b"], ["c"])
    return MO.class_weights(pre.transform(df), "label").persist()


NAMES = ["a", "b", "a__was_missing", "c"]


def test_models_beat_the_majority_and_are_ranked(prepared):
    board, fitted = MO.benchmark(prepared, "binary", {"logistic_regression": {}, "decision_tree": {"maxDepth": 5}, "gradient_boosting": {"maxIter": 5, "maxDepth": 3}, "nonsense": {}})
    rows = board.collect()
    assert len(rows) == 4 and rows[-1].model == "nonsense" and rows[-1].notes.startswith("failed")
    auc = [r.roc_auc for r in rows[:3]]
    assert auc == sorted(auc, reverse=True) and min(auc) > 0.9
    p = MO.score(fitted[0], prepared).select(F.aggregate(F.expr("array(p)"), F.lit(0.0), lambda s, v: s + v).alias("p")).agg(F.min("p"), F.max("p")).first()
    assert 0 <= p[0] <= p[1] <= 1


def test_explanations_find_the_strong_feature(spark, prepared):
    f = MO.fit_model("gradient_boosting", prepared, "binary", {"maxIter": 5, "maxDepth": 3})
    rows = EX.feature_rows(prepared.where("split = 'test'"), "id", "label").persist()
    pred = EX.predictor(f)
    perm = EX.permutation_importance(rows, pred, NAMES, repeats=2).orderBy(F.desc("importance_mean")).collect()
    assert perm[0].feature == "a" and perm[0].importance_mean > 0.2
    few = rows.orderBy("row_id").limit(6).persist()
    shap = EX.sampled_shapley(few, pred, NAMES, orders=4).persist()
    means = few.agg(F.array(*[F.avg(F.element_at("x", i + 1)) for i in range(4)]).alias("x")).select(F.lit(-1).cast("long").alias("row_id"), "x")
    p0 = pred(means).first().p
    total = shap.groupBy("row_id").agg(F.sum("shap").alias("s")).join(pred(few.select("row_id", "x")), "row_id").collect()
    assert all(r.s == pytest.approx(r.p - p0, abs=1e-9) for r in total)
    assert EX.local_attribution(shap, 2, 3).count() == 6
    assert EX.partial_dependence(rows, pred, NAMES, ["a"], points=5).count() == 5
    logit = MO.fit_model("logistic_regression", prepared, "binary", {})
    lin = EX.global_attribution(EX.linear_shapley(rows, logit.model.coefficients, NAMES)).collect()
    assert lin[0].feature == "a" and sum(r.share_pct for r in lin) == pytest.approx(100)
    lime = EX.local_surrogate(rows, few.limit(1), EX.predictor(logit), NAMES, samples=400).orderBy("rank").collect()
    assert lime[0].feature == "a" and lime[0].local_weight > 0


def test_nearest_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.3, (120, 5)) for c in (0, 3, 8)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vid long, emb array<double>")
    got = CL.nearest_neighbours(df, df, "vid", "emb", 7, pivots=6, block=50).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :7]
    have = got.sort_values(["query", "rank"]).distance.to_numpy().reshape(360, 7)
    assert np.allclose(have, want)


def test_closest_rows_are_measured_exactly(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(CL, "TILE", 64)
    for n, m, k, own in ((300, 500, 7, True), (5, 3, 7, True), (50, 2300, 4, False)):
        x, y = rng.normal(size=(n, 6)), rng.normal(size=(m, 6))
        half = min(n, m) // 2
        y[:half] = x[:half]
        y[-1] = y[0]
        if n > 100:  # copies, and rows that products say nothing about
            y[100:300], y[3, 2], y[9], x[5], x[9] = y[100], np.nan, 1e200, np.inf, 1e200
        ids, others = np.arange(n), rng.permutation(m)
        others[m // 2 : m // 2 + 3] = 1
        with np.errstate(all="ignore"):
            d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
            if own:
                d[ids[:, None] == others[None]] = np.inf
            want = [(i, others[j], d[i, j]) for i in range(n) for j in np.lexsort((others, d[i]))[:k] if np.isfinite(d[i, j])]
            rows, cols, dist = CL._closest(x, y, ids, others, k, own)
        assert want == list(zip(rows, others[cols], dist))


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.normal((0, 0), 0.3, (80, 2)), rng.normal((4, 4), 0.3, (60, 2)), rng.uniform(-8, 8, (25, 2)), np.zeros((10, 2))])
    eps, need = 0.5, 6
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    core = (d <= eps).sum(1) >= need
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, x double, y double")
    got = CL.dbscan(df, "id", "x", "y", eps, need).orderBy("id").toPandas()
    assert (got.is_core.to_numpy() == core).all()
    reach = ((d <= eps) & core[None]).any(1)
    assert ((got.cluster.to_numpy() >= 0) == reach).all()
    comp = np.arange(len(pts))
    for _ in range(len(pts)):
        new = np.array([comp[(d[i] <= eps) & core].min() if core[i] else comp[i] for i in range(len(pts))])
        if (new == comp).all():
            break
        comp = new
    pairs = pd.DataFrame({"a": comp[core], "b": got.cluster.to_numpy()[core]}).drop_duplicates()
    assert pairs.a.is_unique and pairs.b.is_unique


def test_core_points_are_those_of_the_clusters_and_link_none(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (300, 2)))] + [(300, None, 1.0), (301, 50.0, 50.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    want = {r["id"]: r["is_core"] for r in CL.dbscan(df, "id", "x", "y", 0.3, 8).collect()}
    monkeypatch.setattr(CL, "_close_cells", None)
    assert {r["id"]: r["is_core"] for r in CL.core_points(df, "id", "x", "y", 0.3, 8).collect()} == want
    assert True in want.values() and not want[300] and not want[301]
    monkeypatch.setattr(MQ.CL, "dbscan", None)
    assert MQ.density_core_points(spark, "/root/testdata/sf0.001").count() == 1000


def test_isolation_forest_flags_the_outlier(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (300, 3)), [[9, 9, 9]]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vid long, emb array<double>")
    nodes = CL.isolation_forest(df, "vid", "emb", trees=30, sample=64)
    s = CL.flag_anomalies(CL.isolation_scores(df, "emb", nodes), 0.02)
    top = s.orderBy(F.desc("anomaly_score")).first()
    assert top.vid == 300 and top.is_anomaly and s.where("is_anomaly").count() == 6


def test_cheapest_matching_is_optimal():
    import itertools

    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 5), (4, 4), (5, 7)):
        c = rng.uniform(0, 10, (n, m))
        pick = PL._cheapest_matching(c)
        best = min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert len(set(pick)) == n and c[np.arange(n), pick].sum() == pytest.approx(best)


def test_fleet_assignment_uses_each_vehicle_once(spark):
    routes = spark.createDataFrame([(i % 2, i, float(i % 50), i % 5 == 0, float(20 + i)) for i in range(120)], "site long, route_id long, load double, cold boolean, km double")
    fleet = spark.createDataFrame([(i % 2, i, float(10 + i), i % 2 == 0, 5.0 + i % 7) for i in range(50)], "site long, vehicle_id long, capacity double, refrigerated boolean, rate double")
    out = PL.fleet_assignment(routes, fleet, "site", 20, 30).toPandas()
    used = out.dropna(subset=["vehicle_id"])
    assert len(out) == 120 and used.vehicle_id.is_unique and out.cost.sum() <= out.first_come_cost.sum() + 1e-6
    v = fleet.toPandas().set_index("vehicle_id")
    both = used.join(v[["capacity", "refrigerated"]], on="vehicle_id")
    assert (both.capacity >= both.load).all() and (~both.cold | both.refrigerated).all()


def test_routes_serve_each_stop_once_within_capacity(spark):
    stops = spark.createDataFrame(
        [(1 if i < 150 else 2, f"s{i}", float(i * 37 % 20), float(i * 91 % 20), 10.0, 10.0, 500.0 if i == 7 else float(i % 9 + 1)) for i in range(170)],
        "site int, stop_id string, lat double, lon double, depot_lat double, depot_lon double, demand_kg double")
    r = PL.routes_for_all(stops, ["site"], 40.0, max_stops=60).persist()
    assert r.count() == 170 and r.select("stop_id").distinct().count() == 170
    assert [x.stop_id for x in r.where("route_no is null").collect()] == ["s7"]
    lengths = PL.route_length(r, ["site", "sector", "route_no"]).toPandas()
    assert (lengths.load_kg <= 40).all() and (lengths.km >= 0).all()
    assert r.groupBy("site", "sector").count().agg(F.max("count")).first()[0] <= 60


def test_two_opt_never_lengthens():
    rng = np.random.default_rng(4)
    lat, lon = rng.uniform(0, 5, 30), rng.uniform(0, 5, 30)
    km = PL._km_matrix(lat, lon)
    tour = np.r_[0, rng.permutation(np.arange(1, 30)), 0]
    length = lambda t: km[t[:-1], t[1:]].sum()
    before = length(tour)
    after = PL._shorten(tour.copy(), km)
    assert sorted(after[:-1]) == list(range(30)) and length(after) < before


def test_shift_cover_rules(spark):
    drivers = spark.createDataFrame([(1, i, 10.0 + i) for i in range(40)], "site int, driver long, hourly double")
    out = PL.greedy_shift_cover(drivers, "site", "driver", "hourly").toPandas()
    assert out.available.all() and out.groupby(["team", "driver_id"]).size().max() <= 5 and out.groupby(["team", "shift"]).size().max() <= 2
    for _, g in out.groupby(["team", "driver_id"]):
        assert (g["shift"].sort_values().diff().dropna() > 1).all()


def test_forecast_recovers_known_factors(spark):
    factors = [1.2, 1.1, 1.0, 1.0, 1.3, 0.8, 0.6]
    days = pd.date_range("2023-01-02", periods=730)
    rows = [(d.date(), float(round((200 + 0.1 * i) * factors[d.dayofweek])), i) for i, d in enumerate(days)]
    daily = spark.createDataFrame(rows, "day date, orders double, idx int")
    _, _, dow = FC.decompose(daily)
    got = {r.dow: r.factor_dow for r in dow.collect()}
    mean = sum(factors) / 7
    assert all(abs(got[i] - factors[i] / mean) < 0.02 for i in range(7))
    f = FC.demand_forecast(daily).orderBy("h").toPandas()
    width = f.upper - f.lower
    assert len(f) == 30 and (f.lower <= f.point).all() and (f.point <= f.upper).all() and width.is_monotonic_increasing
    acc = FC.forecast_accuracy(daily).first()
    assert acc.holdout_days == 30 and acc.mape < 3
    assert FC.demand_forecast(daily.where("idx < 40")).count() == 0


def test_scenarios_move_the_right_way(spark):
    base = spark.createDataFrame([(1000, 90.0, 5000.0, 9000.0, 8000.0, 2.0, 0.3, 2.0, 0.2, 8.0)], "orders long, on_time_rate double, total_cost double, total_revenue double, total_km double, total_co2 double, fuel_per_km double, labour_per_order double, other_share double, km_per_order double")
    gaps = spark.createDataFrame([(0.03, 0.02)], "quartile_gap double, adverse_gap double")
    t = {r.scenario: r for r in FC.scenario_table(base, gaps, {"jam": {"traffic": 200}, "surge": {"demand": 250}, "tight": {"route": 100}}).collect()}
    b = t["baseline"]
    assert b.on_time == pytest.approx(90) and b.on_time_index == 100 and b.margin_change == 0
    assert t["jam"].on_time < b.on_time and t["jam"].cost > b.cost and t["surge"].pressure == 2.5
    assert t["tight"].km_per_order < b.km_per_order and t["tight"].on_time > b.on_time and all(15 <= r.on_time <= 99.5 for r in t.values())


def test_prepared_rows_are_dealt_into_parts_of_bounded_size(spark, sf, monkeypatch):
    from fleetspan.plans import model_queries as MQ

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert MO.parts_for(spark, 10) == parts and MO.parts_for(spark, 360 * MO.PART_ROWS + 1) == 361
    monkeypatch.setattr(MO, "PART_ROWS", 400)
    rows = MQ._prepared.__wrapped__(spark, sf)[0]
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    rows.unpersist()
    assert sum(sizes) > 10 * 400 and max(sizes) <= 450


def test_sampled_shapley_scores_each_feature_set_once(spark):
    rows = spark.range(50).select(F.col("id").alias("row_id"), F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(4)]).alias("x"))
    seen = []

    def predict(df):
        seen.append(df.count())
        return df.withColumn("p", F.get("x", F.lit(0)) * F.get("x", F.lit(1)) - 3 * F.get("x", F.lit(3)))

    out = EX.sampled_shapley(rows, predict, list("abcd"), orders=6)
    assert seen == [50 * (6 * 3 + 2)] and "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    x = np.array([r["x"] for r in rows.orderBy("row_id").collect()])
    got = out.toPandas().pivot(index="row_id", columns="feature", values="shap").to_numpy()
    mean = x.mean(0)
    score = lambda v: v[..., 0] * v[..., 1] - 3 * v[..., 3]
    assert np.allclose(got.sum(1), score(x) - score(mean)) and np.allclose(got[:, 2], 0) and np.allclose(got[:, 3], -3 * (x[:, 3] - mean[3]))


def test_global_attribution_works_out_the_values_once(spark):
    calls = spark.sparkContext.accumulator(0)
    told = F.udf(lambda i: calls.add(1) or float(i % 3 - 1), "double")
    shap = spark.range(30, numPartitions=2).select((F.col("id") / 3).cast("long").alias("row_id"), F.concat(F.lit("f"), F.col("id") % 3).alias("feature"), told("id").alias("shap"))
    got = {r["feature"]: (r["mean_abs"], r["share_pct"]) for r in EX.global_attribution(shap).collect()}
    assert got == {"f0": (1.0, 50.0), "f1": (0.0, 0.0), "f2": (1.0, 50.0)} and calls.value == 30


def test_class_weights_do_not_gather_a_class_in_one_task(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(0, 4000, 1, 8).select((F.col("id") % 4 == 0).cast("double").alias("label"), F.spark_partition_id().alias("part"))
        out = MO.class_weights(rows, "label")
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        got = out.withColumn("stays", (F.col("part") == F.spark_partition_id()).cast("int")).groupBy("label", "weight").agg(F.count("*").alias("n"), F.sum("stays").alias("stay")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(tuple(r) for r in got) == [(0.0, 4000 / (2 * 3000), 3000, 3000), (1.0, 2.0, 1000, 1000)]


def test_permutation_importance_scores_each_row_once(spark):
    rows = spark.range(400).select(F.col("id").alias("row_id"), F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(3)]).alias("x")).withColumn("y", (F.col("x")[0] > 0.2).cast("double"))
    calls = spark.sparkContext.accumulator(0)
    told = F.udf(lambda x: calls.add(1) or round(x[0] + x[1] / 4, 1), "double").asNondeterministic()
    predict = lambda df: df.withColumn("p", told("x"))
    got = {r["feature"]: r["importance_mean"] for r in EX.permutation_importance(rows, predict, list("abc"), repeats=2).collect()}
    assert calls.value == 400 * (1 + 2 * 3)
    assert got["a"] > 0.1 and got["c"] == 0


def test_agreement_works_out_both_rankings_once(spark):
    calls = spark.sparkContext.accumulator(0)
    told = F.udf(lambda i: calls.add(1) or float(i), "double").asNondeterministic()
    a = spark.range(10, numPartitions=2).select(F.col("id").alias("feature"), told("id").alias("a"))
    b = spark.range(10, numPartitions=2).select(F.col("id").alias("feature"), (-told("id")).alias("b"))
    assert EX.ranking_agreement(a, b, "a", "b").select("spearman").distinct().collect() == [(-1.0,)]
    assert calls.value == 20


def test_grouped_auc_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    y, p, g = rng.integers(0, 2, 600), rng.integers(0, 40, 600) / 39 + rng.integers(0, 3, 600) * 1e-5, rng.integers(0, 3, 600)
    got = {r["g"]: r["s"] for r in EX.grouped_auc(spark.createDataFrame(pd.DataFrame({"g": g, "y": y, "p": p})), ["g"]).collect()}
    for k in range(3):
        pos, neg = p[(g == k) & (y == 1)][:, None], p[(g == k) & (y == 0)]
        assert got[k] == pytest.approx(((pos > neg) + (pos == neg) / 2).mean(), abs=1e-12)


def test_prepared_rows_join_the_tables_once(spark, sf, monkeypatch):
    made = []
    lines = MQ.line_rows
    calls = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: calls.add(1) or x, "long").asNondeterministic()
    monkeypatch.setattr(MQ, "line_rows", lambda *a: made.append(1) or lines(*a).withColumn("line_id", seen("line_id")))
    rows = MQ._prepared.__wrapped__(spark, sf)[0]
    assert made == [1] and calls.value == rows.count() == MQ.training_rows(spark, sf).count()
    rows.unpersist()
