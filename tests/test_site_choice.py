"""Site choice against the plain greedy rule over all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from fleetspan.operators import site_choice as SC


def plain_greedy(zones, sites, max_open, per_km=0.02):
    """(site_id, total) of every round, from a full table of costs."""
    lat, lon, demand = (np.array([z[k] for z in zones], float) for k in (1, 2, 3))
    cost = SC._km(lat[:, None], lon[:, None], np.array([s[1] for s in sites], float), np.array([s[2] for s in sites], float)) * demand[:, None] * per_km
    fixed = np.array([s[3] or 0.0 for s in sites]) / 1000
    best, spent, out, open_ = np.full(len(zones), np.inf), 0.0, [], []
    for _ in range(min(max_open, len(sites))):
        totals = np.minimum(best[:, None], cost).sum(0) + fixed + spent
        j = min((j for j in range(len(sites)) if j not in open_), key=lambda j: (totals[j], sites[j][0]))
        out.append((sites[j][0], totals[j]))
        best, spent = np.minimum(best, cost[:, j]), spent + fixed[j]
        open_.append(j)
    return out


def tables(spark, seed, n_zones, n_sites, spread):
    rng = np.random.default_rng(seed)
    zones = [(i, float(a), float(b), float(d)) for i, (a, b, d) in enumerate(zip(rng.normal(45, spread, n_zones).clip(-89, 89), rng.normal(8, spread, n_zones), rng.integers(0, 9, n_zones)))]
    sites = [(f"WH-{j:04d}", float(a), float(b), None if j % 5 == 0 else float(c)) for j, (a, b, c) in enumerate(zip(rng.normal(45, spread, n_sites).clip(-89, 89), rng.normal(8, spread, n_sites), rng.integers(0, 90_000, n_sites)))]
    return zones, sites, spark.createDataFrame(zones, "zone_id long, lat double, lon double, demand double"), spark.createDataFrame(sites, "site_id string, lat double, lon double, fixed_cost double")


@pytest.mark.parametrize("seed, n_zones, n_sites, spread, batch", [(0, 400, 150, 12.0, 64), (1, 300, 200, 40.0, 3), (2, 50, 3, 1.0, 64)])
def test_greedy_is_that_of_all_pairs(spark, monkeypatch, seed, n_zones, n_sites, spread, batch):
    monkeypatch.setattr(SC, "BATCH", batch)
    zones, sites, z, s = tables(spark, seed, n_zones, n_sites, spread)
    got = [(r["site_id"], r["total_cost"]) for r in SC.greedy_sites(z, s, 4).orderBy("round").collect()]
    want = plain_greedy(zones, sites, 4)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want])


def test_bounds_hold_and_drop_sites(spark, monkeypatch):
    zones, sites, z, s = tables(spark, 3, 500, 300, 30.0)
    asked = []
    measure = SC._measured
    monkeypatch.setattr(SC, "BATCH", 16)
    monkeypatch.setattr(SC, "_measured", lambda zz, batch, per_km: asked.append(len(batch)) or measure(zz, batch, per_km))
    got = SC.greedy_sites(z, s, 3).orderBy("round").collect()
    assert [r["site_id"] for r in got] == [w[0] for w in plain_greedy(zones, sites, 3)]
    assert sum(asked) < 300  # all sites in all rounds would be 897


def test_assignment_and_totals(spark):
    zones, sites, z, s = tables(spark, 4, 200, 40, 20.0)
    km = SC._km(*(np.array([x[k] for x in zones])[:, None] for k in (1, 2)), *(np.array([x[k] for x in sites]) for k in (1, 2)))
    demand = np.array([x[3] for x in zones])
    totals = {r["site_id"]: r for r in SC.service_totals(z, s).collect()}
    for j, site in enumerate(sites):
        assert totals[site[0]]["zones"] == 200 and totals[site[0]]["cost"] == pytest.approx((km[:, j] * demand * 0.02).sum()) and totals[site[0]]["avg_km"] == pytest.approx(km[:, j].mean())
    opened = s.where("site_id in ('WH-0003', 'WH-0017', 'WH-0030')")
    for r in SC.nearest_open_site(z, s, opened).collect():
        want = min((km[r["zone_id"], j] * demand[r["zone_id"]] * 0.02, sites[j][0]) for j in (3, 17, 30))
        assert (pytest.approx(want[0]), want[1]) == (r["cost"], r["site_id"])


def test_empty_tables(spark):
    _, _, z, s = tables(spark, 5, 5, 3, 5.0)
    assert SC.greedy_sites(z, s.limit(0)).count() == 0
    assert SC.greedy_sites(z.limit(0), s, 2).count() == 2
    assert SC.service_totals(z.limit(0), s).count() == 0 and SC.nearest_open_site(z, s, s.limit(0)).count() == 0


def test_no_row_a_pair(spark):
    """Zones and sites are never joined row by row, whatever the plan."""
    _, _, z, s = tables(spark, 6, 50, 20, 5.0)
    plan = SC.nearest_open_site(z, s, s.limit(3))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Generate" not in plan


def test_zones_and_sites_at_one_place_are_met_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    zones = [(i, float(i % 7 * 9 - 30), float(i % 5 * 20 - 40), float(i % 3 + 1)) for i in range(700)]
    sites = [(j, float(j % 4 * 15 - 20), float(j % 3 * 30 - 30), float(rng.integers(0, 4) * 1000)) for j in range(240)]
    z, s = spark.createDataFrame(zones, "zone_id long, lat double, lon double, demand double"), spark.createDataFrame(sites, "site_id long, lat double, lon double, fixed_cost double")
    seen, measure = [], SC._measured
    monkeypatch.setattr(SC, "_measured", lambda zz, batch, per_km: seen.append((zz.count(), len(batch))) or measure(zz, batch, per_km))
    got = [(r["site_id"], r["total_cost"]) for r in SC.greedy_sites(z, s, 3).orderBy("round").collect()]
    want = plain_greedy(zones, sites, 3)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])
    assert max(n for n, _ in seen) == 35 and max(b for _, b in seen) <= 36  # 35 places of zones, 12 of sites with 3 each
