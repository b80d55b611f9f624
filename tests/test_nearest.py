"""The pyramid search for nearest sites, and the draws of isolation trees."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspan.operators import clustering as CL
from fleetspan.operators import joins as J
from fleetspan.operators.site_choice import _km


@pytest.mark.parametrize("seed, n_sites, spread", [(0, 200, 180.0), (1, 300, 0.2), (2, 1, 10.0)])
def test_nearest_of_against_all_pairs(spark, seed, n_sites, spread):
    rng = np.random.default_rng(seed)
    lat, lon = rng.uniform(-90, 90, 150), rng.uniform(-180, 180, 150)
    lat[:3], lon[:3] = (90, -90, 10), (0, 0, 180)
    slat, slon = (rng.uniform(-1, 1, n_sites) * spread / 2).clip(-90, 90), rng.uniform(-1, 1, n_sites) * spread
    slat[-1], slon[-1] = slat[0], slon[0]  # two sites at one place
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))] + [(900, None, 1.0)], "p long, lat double, lon double")
    sites = spark.createDataFrame([(f"S{j:03d}", float(a), float(b)) for j, (a, b) in enumerate(zip(slat, slon))] + [("none", 1.0, None)], "s string, lat double, lon double")
    got = {r["p"]: (r["s"], r["km"]) for r in J.nearest_of(points, sites, "p", "s").collect()}
    km = _km(lat[:, None], lon[:, None], slat, slon)
    assert len(got) == 150
    for i in range(150):
        assert got[i][1] == pytest.approx(km[i].min(), abs=1e-7) and km[i, int(got[i][0][1:])] == pytest.approx(km[i].min(), abs=1e-7)
    same = [i for i in range(150) if km[i].argmin() in (0, n_sites - 1)]
    assert all(got[i][0] == "S000" for i in same)
    assert J.nearest_of(points, sites.limit(0), "p", "s").count() == 0


def test_isolation_draws_depend_on_rows_only(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=3)]) for i in range(500)], "vid long, emb array<double>")
    nodes = lambda d, k: sorted(map(tuple, CL.isolation_forest(d, "vid", "emb", trees=5, sample=k).collect()))
    assert nodes(df.repartition(7), 64) == nodes(df.coalesce(1), 64)
    sizes = CL.isolation_forest(df, "vid", "emb", trees=5, sample=64).where("node = 0").select("size").collect()
    assert [r["size"] for r in sizes] == [64] * 5
    few = CL.isolation_forest(df.where("vid < 20"), "vid", "emb", trees=3, sample=64)
    assert {r["size"] for r in few.where(F.col("node") == 0).collect()} == {20}


def test_k_nearest_against_all_pairs_and_without_listing_the_radius(spark):
    rng = np.random.default_rng(7)
    lat, lon = rng.integers(-9, 10, 400) * 10.0, rng.integers(-18, 19, 400) * 10.0
    slat, slon = rng.integers(-4, 5, 250) * 20.0, rng.integers(-4, 5, 250) * 40.0
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], "p long, lat double, lon double")
    sites = spark.createDataFrame([(j, float(a), float(b)) for j, (a, b) in enumerate(zip(slat, slon))], "s long, lat double, lon double")
    km = _km(lat[:, None], lon[:, None], slat, slon)
    got = J.k_nearest(points, sites, "p", "s", 7).toPandas().sort_values(["p", "rank"])
    assert len(got) == 2800 and (got.groupby("p")["rank"].max() == 7).all()
    for i, g in got.groupby("p"):
        assert g.km.to_numpy() == pytest.approx(np.sort(km[i])[:7], abs=1e-7) and g.s.nunique() == 7
        assert g.km.to_numpy() == pytest.approx(km[i][g.s.to_numpy()], abs=1e-7)
    assert J.k_nearest(points, sites.where("s < 3"), "p", "s", 5).count() == 1200  # fewer sites than asked for
    tiers = J.nearest_sites(points, sites, "p", "s", 3, 1500.0, 3000.0, 6)
    told = {(r["p"], r["rank"]): (r["tier"], r["km"]) for r in tiers.collect()}
    for i in range(400):
        near = np.sort(km[i])[:6]
        want = {1: "near" if near[0] <= 1500 else "nearest"} | {r: "near" for r in (2, 3) if near[r - 1] <= 1500} | {r: "far" for r in (4, 5, 6) if near[r - 1] <= 3000}
        assert {r: t for (p, r), (t, _) in told.items() if p == i} == want
    # pairs within the radius are not listed: the sites of one place beyond the k-th, and distant ones, meet no point
    plan = tiers._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan.lower()
