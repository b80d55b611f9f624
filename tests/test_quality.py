from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetspan.operators import cleaning as C
from fleetspan.operators import joins as J
from fleetspan.operators import quality as Q
from fleetspan.operators import tasks as TA
from fleetspan.operators.physics import drop_columns


@pytest.fixture(scope="module")
def base(spark):
    return spark.range(6000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 1009).cast("double").alias("v"), (F.col("id") % 5).cast("string").alias("g"))


@pytest.mark.parametrize("rule", [
    Q.MaskRule("v", "MCAR", 0.1), Q.MaskRule("v", "MAR", 0.1, driver="k"), Q.MaskRule("v", "MAR", 0.1, driver="g", numeric_driver=False), Q.MaskRule("v", "MNAR", 0.1)])
def test_achieved_rate_is_near_the_target(base, rule):
    gone, truth, report = Q.apply_missingness(base, "t", ["k"], [rule])
    r = report.first()
    assert abs(r.achieved_rate - 0.1) < 0.03 and r.n_missing == truth.count() == gone.where("v is null").count()
    assert r.mechanism == rule.mechanism and r.n_missing_before == 0


def test_mnar_high_lowers_the_observed_mean_and_mcar_does_not(base):
    full = base.agg(F.avg("v")).first()[0]
    hidden = Q.apply_missingness(base, "t", ["k"], [Q.MaskRule("v", "MNAR", 0.3)])[0].agg(F.avg("v")).first()[0]
    flat = Q.apply_missingness(base, "t", ["k"], [Q.MaskRule("v", "MCAR", 0.3)])[0].agg(F.avg("v")).first()[0]
    assert hidden < full - 20 and abs(flat - full) < 15


def test_masks_repeat_and_seeds_differ(base):
    a = Q.mask_mcar(base, ["k"], "v", 0.2).where("_mask").count()
    b = Q.mask_mcar(base.repartition(3), ["k"], "v", 0.2).where("_mask").count()
    c = Q.mask_mcar(base, ["k"], "v", 0.2, seed=1).where("_mask").select("k")
    assert a == b and c.exceptAll(Q.mask_mcar(base, ["k"], "v", 0.2).where("_mask").select("k")).count() > 0


def test_duplicates_are_found_again(spark):
    rows = [(i, i % 50, float(i), dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "order_id long, cust long, value double, ts timestamp_ntz")
    made = Q.inject_duplicates(df, "order_id", "ts", 0.1)
    dups = made.where("is_duplicate")
    n = dups.count()
    assert 60 < n < 140 and dups.where(~F.col("order_id").endswith("-DUP")).count() == 0
    from fleetspan.operators.ordered import time_bucket

    found = Q.detect_duplicates(made, ["cust", "value"], ["ts", "order_id"], time_bucket("ts"), "ts", "order_id", block=4)
    assert found.count() == n and found.agg(F.max("gap_seconds")).first()[0] < 240


def test_windows_tag_closed_ends_and_both_windows(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    df = spark.createDataFrame([(i, "x", t(i)) for i in range(60)], "id long, place string, ts timestamp_ntz")
    win = spark.createDataFrame([(1, "x", t(5), t(30)), (2, "x", t(30), t(31)), (3, "y", t(0), t(50))], "window_id long, place string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    tags = J.event_window_tag(df, win.withColumnRenamed("place", "wp"), "place", "ts", w_place="wp")
    assert tags.count() == 26 + 2 and tags.where("id = 30").count() == 2


def test_orphans_skip_null_keys(spark):
    child = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, fk string")
    parent = spark.createDataFrame([("a",), ("b",)], "pk string")
    assert [r.id for r in J.anti_join_orphans(child, "fk", parent, "pk").collect()] == [3]
    assert Q.fk_report({"c": child, "p": parent}, [("c", "fk", "p", "pk")]).first().orphans == 1


def test_cleaning_leaves_no_nulls_and_replays(spark, base):
    df = base.select("k", F.when(F.col("k") % 9 != 0, F.col("v")).alias("v"), F.when(F.col("k") % 11 != 0, F.col("g")).alias("g"), F.lit(3).alias("same"), F.col("v").alias("margin_usd"), F.col("v").alias("target_x"), F.col("k").cast("string").alias("row_id"))
    out, meta = C.clean_table(df, ["margin_usd"])
    assert "same" not in out.columns and "margin_usd" not in out.columns and {"v__was_missing", "g__was_missing"} <= set(out.columns)
    assert out.where(" or ".join(f"`{c}` is null" for c in out.columns)).count() == 0
    again = C.replay(df, C.load_meta(C.save_meta(meta)))
    assert again.columns == out.columns and again.exceptAll(out).count() == 0
    unseen = C.replay(df.limit(1).withColumn("g", F.lit("new")), meta).first()
    assert unseen.g == -1


def test_leakage_guard(spark):
    df = spark.range(1).select("id", F.lit(1).alias("is_late"), F.lit(1).alias("is_late__was_missing"), F.lit(1).alias("order_id"), F.lit("").alias("gps_anomaly_flags"), F.lit(1).alias("target_a"), F.lit(1).alias("keepme"))
    assert drop_columns(df).columns == ["id", "keepme"]
    assert set(TA.TASK_BUILDERS) >= {"late_delivery", "vehicle_failure", "warehouse_congestion"} and len(TA.TASK_BUILDERS) == 11


def test_nearest_sites_matches_brute_force_and_serves_everyone(spark):
    pts = spark.createDataFrame([(i, float((i * 37) % 178 - 89), float((i * 91) % 360 - 180)) for i in range(300)], "p long, lat double, lon double")
    sites = spark.createDataFrame([(i, float((i * 53) % 150 - 75), float((i * 67) % 360 - 180)) for i in range(12)], "s long, lat double, lon double")
    got = J.nearest_sites(pts, sites, "p", "s", 2, 900.0)
    assert got.select("p").distinct().count() == 300
    from fleetspan.functions.geo import haversine_km

    allp = pts.crossJoin(sites.select("s", F.col("lat").alias("a"), F.col("lon").alias("b"))).select("p", "s", haversine_km("lat", "lon", "a", "b").alias("km")).toPandas()
    best = allp.sort_values(["km", "s"]).groupby("p").head(1).set_index("p")
    near = allp[allp.km <= 900].sort_values(["km", "s"]).groupby("p").head(2)
    g = got.toPandas()
    assert len(g[g.tier == "near"]) == len(near)
    far = g[g.tier == "nearest"].set_index("p")
    assert (best.loc[far.index].s == far.s).all() and len(far) == 300 - near.p.nunique()


def test_cheapest_vehicle_matches_theta_join(spark):
    prof = spark.createDataFrame([(float(c), c % 3 == 0, 5.0 + (c * 7) % 11) for c in range(3, 130, 4)], "capacity double, refrigerated boolean, rate double")
    need = spark.createDataFrame([(i, float(i), i % 2 == 0, 10.0) for i in range(140)], "r long, load double, cold boolean, km double")
    got = J.feasible_pairs(need, prof, "load", "cold", "km", band=25.0).orderBy("r").toPandas()
    p = prof.toPandas()
    for row in got.itertuples():
        ok = p[(p.capacity >= row.load) & (p.refrigerated | (not row.cold))]
        assert (ok.empty and row.rate != row.rate) or row.rate == ok.rate.min()


def test_salted_lookup_equals_plain(spark, base):
    dim = spark.createDataFrame([(str(i), f"n{i}") for i in range(4)], "g string, name string")
    a = J.lookup_join(base, dim, "g", "g", {"name": "name"})
    b = J.lookup_join(base, dim, "g", "g", {"name": "name"}, salt=5)
    assert a.count() == b.count() == 6000 and a.exceptAll(b).count() == 0
