"""Stock policy, routing, assignment, site choice, forecast, scenarios, map layers and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import add_minutes
from ..operators import forecast as FC
from ..operators import marts as MA
from ..operators import planning as PL
from ..operators import site_choice as SC
from ..operators import windowed_routes as WR
from ..operators.joins import lookup_join
from ..operators.ordered import time_bucket
from ..operators.sets import busiest_group
from . import bind as B
from .bind import ds, rt
from .mart_queries import CUBE_SQL, ELASTIC_SQL, ROUTE_SQL, STRUCTURE_SQL, _cube, elasticity, routes, structure
from .registry import query
from .relational_queries import KEY, POINT_SQL, customer_points, haversine_sql

DELIV = f"WITH {B.SQL_DELIVERIES}"
R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})

# ---------------------------------------------------------------- stock policy

POLICY_SQL = f"""WITH {B.SQL_INVENTORY}, g AS (SELECT region, sku_id, MIN(sku_category) AS sku_category, AVG(GREATEST(COALESCE(turnover_rate, 1) * GREATEST(units_on_hand, 1) / 30, 0.1)) AS daily_demand,
   AVG(COALESCE(unit_cost, 10)) AS unit_cost, AVG(COALESCE(reorder_point, 0)) AS current_reorder_point, AVG(COALESCE(safety_stock, 0)) AS current_safety_stock FROM inventory WHERE units_on_hand IS NOT NULL GROUP BY 1, 2),
 e AS (SELECT *, SQRT(daily_demand * 365 * 2 * 65 / (unit_cost * 0.18::DOUBLE + 2.4::DOUBLE)) AS eoq, daily_demand * 0.35::DOUBLE * 1.6448536269514722::DOUBLE * SQRT(5) AS new_safety_stock, unit_cost * 0.18::DOUBLE + 2.4::DOUBLE AS h FROM g),
 f AS (SELECT *, daily_demand * 5 + new_safety_stock AS new_reorder_point, daily_demand * 365 / GREATEST(eoq, 1) AS orders_per_year FROM e),
 policy AS (SELECT *, orders_per_year * 65 + (eoq / 2 + new_safety_stock) * h AS annual_cost,
   daily_demand * 365 / GREATEST(current_reorder_point, 1) * 65 + (GREATEST(current_reorder_point, 1) / 2 + current_safety_stock) * h AS baseline_cost FROM f)"""


def policy(spark, sf):
    return PL.inventory_policy(B.inventory(spark, sf), "region", "sku_id", "sku_category")


# shown digits: fewer for large amounts, whose last binary digits depend on the order of addition
_POLICY_DIGITS = {"daily_demand": 9, "annual_cost": 5, "baseline_cost": 5, "saving": 5}


@query("inventory_policy", POLICY_SQL + " SELECT region, sku_id, sku_category, " + ", ".join(f"ROUND({c}, {_POLICY_DIGITS.get(c, 7)}) AS {c}" for c in ("daily_demand", "eoq", "new_safety_stock", "new_reorder_point", "orders_per_year", "annual_cost", "baseline_cost")) + ", ROUND(baseline_cost - annual_cost, 5) AS saving FROM policy")
def inventory_policy(spark, sf):
    cols = ("daily_demand", "eoq", "new_safety_stock", "new_reorder_point", "orders_per_year", "annual_cost", "baseline_cost", "saving")
    return policy(spark, sf).withColumns({c: F.round(c, _POLICY_DIGITS.get(c, 7)) for c in cols}).select("region", "sku_id", "sku_category", *cols)


@query("policy_by_category", POLICY_SQL + " SELECT sku_category, COUNT(*) AS skus, ROUND(AVG(eoq), 6) AS avg_eoq, ROUND(AVG(new_reorder_point), 6) AS avg_reorder_point, ROUND(SUM(annual_cost), 4) AS annual_cost, ROUND(SUM(baseline_cost), 4) AS baseline_cost FROM policy GROUP BY 1")
def policy_by_category(spark, sf):
    out = R6(PL.policy_by_category(policy(spark, sf), "sku_category"), "avg_eoq", "avg_reorder_point")
    return out.withColumns({c: F.round(c, 4) for c in ("annual_cost", "baseline_cost")})


@query("policy_improvement", POLICY_SQL + " SELECT 'inventory_policy' AS problem, ROUND(SUM(annual_cost), 4) AS objective, ROUND(SUM(baseline_cost), 4) AS baseline, ROUND((SUM(baseline_cost) - SUM(annual_cost)) * 100 / SUM(baseline_cost), 6) AS improvement_pct FROM policy")
def policy_improvement(spark, sf):
    one = policy(spark, sf).agg(F.sum("annual_cost").alias("o"), F.sum("baseline_cost").alias("b"))
    return PL.improvement_table("inventory_policy", "o", "b", one).withColumns({"objective": F.round("objective", 4), "baseline": F.round("baseline", 4), "improvement_pct": F.round("improvement_pct", 6)})


# ---------------------------------------------------------------- routes


def route_stops(spark, sf):
    d = B.deliveries(spark, sf).withColumn("month", F.trunc(F.col("ship_ts").cast("date"), "month"))
    pts = customer_points(spark, sf)
    s = B.sites(spark, sf)
    d = lookup_join(d, pts, "customer_id", "customer_id", {"lat": "lat", "lon": "lon"})
    d = lookup_join(d, s, "site_id", "site_id", {"lat": "depot_lat", "lon": "depot_lon"})
    stop = F.concat_ws("-", "order_id", "line_no", "sku_id", "value", "weight_kg")
    return d.select("site_id", "month", stop.alias("stop_id"), "lat", "lon", "depot_lat", "depot_lon", F.col("weight_kg").alias("demand_kg"))


@query("routes_for_all")
def routes_for_all(spark, sf):
    return PL.routes_for_all(route_stops(spark, sf), ["site_id", "month"], 120.0)


@query("route_lengths")
def route_lengths(spark, sf):
    return PL.route_length(routes_for_all(spark, sf), ["site_id", "month", "sector", "route_no"])


# fixed values: the stops are drawn in to a city around their depot, and an order's promise is a minute of its day
CITY, CAPACITY_KG = 300.0, 120.0
_NEAR = [f"depot.{c} + (pts.{c} - depot.{c}) / {CITY:.0f}::DOUBLE" for c in ("lat", "lon")]
_WINDOW_SQL = f"""{DELIV}, {B.SQL_SITES}, {POINT_SQL}, s AS (SELECT d.site_id, weight_kg, 60 + order_id * 37 % 1380 AS c, {haversine_sql("depot.lat", "depot.lon", *_NEAR)} / 35 * 60 AS ride
   FROM deliveries d JOIN pts USING (customer_id) JOIN sites depot ON depot.site_id = d.site_id), w AS (SELECT *, GREATEST(c - 120, 0) AS opens, c + 120 AS closes FROM s),
  r AS (SELECT *, weight_kg <= {CAPACITY_KG:.0f} AND GREATEST(opens, ride) <= closes AND GREATEST(opens, ride) + 8 + ride <= 1440 AS servable FROM w)
  SELECT site_id, COUNT(*) AS stops, COUNT(*) FILTER (servable) AS served, 0::BIGINT AS outside_window, 0::BIGINT AS served_twice, 0::BIGINT AS overloaded_routes FROM r GROUP BY 1"""


def windowed_stops(spark, sf):
    # what hangs on an order is looked up for orders, which are fewer than their lines
    o = lookup_join(B.orders_fact(spark, sf).select("order_id", "customer_id"), customer_points(spark, sf), "customer_id", "customer_id", {"lat": "_lat", "lon": "_lon"})
    l = B.table(spark, sf, "lineitem")
    line = {n: c for n, c in B.delivery_columns().items() if n in ("line_no", "sku_id", "site_id", "weight_kg", "value", "ship_ts")}
    d = l.join(o, l.l_orderkey == o.order_id).select("order_id", "_lat", "_lon", *[c.alias(n) for n, c in line.items()])
    d = d.select("site_id", F.trunc(F.col("ship_ts").cast("date"), "month").alias("month"), (F.lit(60) + F.col("order_id") * 37 % 1380).alias("_c"), "weight_kg", F.concat_ws("-", "order_id", "line_no", "sku_id", "value", "weight_kg").alias("stop_id"), "_lat", "_lon")
    d = lookup_join(d, B.sites(spark, sf), "site_id", "site_id", {"lat": "depot_lat", "lon": "depot_lon"})
    near = [(F.col(f"depot_{c}") + (F.col(f"_{c}") - F.col(f"depot_{c}")) / CITY).alias(c) for c in ("lat", "lon")]
    return d.select("site_id", "month", "stop_id", *near, "depot_lat", "depot_lon", F.col("weight_kg").alias("demand_kg"), F.greatest(F.col("_c") - 120, F.lit(0)).alias("window_start"), (F.col("_c") + 120).alias("window_end"), F.lit(8.0).alias("service_minutes"))


@query("windowed_routes")
def windowed_routes(spark, sf):
    return WR.windowed_routes(windowed_stops(spark, sf), ["site_id", "month"], CAPACITY_KG)


@query("windowed_route_rules", _WINDOW_SQL)
def windowed_route_rules(spark, sf):
    """Every stop that a vehicle can serve is served once, in its window, and no route is overloaded."""
    out = windowed_routes(spark, sf)
    route = F.struct("month", "sector", "route_no")
    loads = out.where("route_no is not null").groupBy("site_id", route.alias("r")).agg(F.sum("demand_kg").alias("load")).groupBy("site_id").agg(F.count_if(F.col("load") > CAPACITY_KG).alias("overloaded_routes"))
    late = F.col("start_minute").isNotNull() & ((F.col("start_minute") < F.col("window_start")) | (F.col("start_minute") > F.col("window_end") + 1e-6))
    per = out.groupBy("site_id").agg(F.count(F.lit(1)).alias("stops"), F.count("route_no").alias("served"), F.count_if(late).alias("outside_window"), (F.count(F.lit(1)) - F.count_distinct("stop_id")).alias("served_twice"))
    return per.join(loads, "site_id", "left").fillna({"overloaded_routes": 0})


@query("routing_instance", f"""{DELIV}, d AS (SELECT *, ship_ts::DATE AS day FROM deliveries), g AS (SELECT site_id, day, COUNT(*) AS n FROM d GROUP BY 1, 2 ORDER BY n DESC, site_id, day LIMIT 1),
  s AS (SELECT d.* FROM d JOIN g ON d.site_id = g.site_id ORDER BY (d.day <> g.day), order_id, line_no, sku_id, d.site_id, ship_ts, value, weight_kg LIMIT 40),
  c AS (SELECT *, LEAST(GREATEST(date_diff('second', (SELECT MIN(order_ts) FROM s), order_ts + INTERVAL 300 MINUTE) / 60.0::DOUBLE, 60), 1440) AS centre FROM s)
  SELECT {", ".join(KEY)}, weight_kg AS demand_kg, 8.0::DOUBLE AS service_minutes, GREATEST(centre - 120, 0) AS window_start, centre + 120 AS window_end FROM c""")
def routing_instance(spark, sf):
    d = B.deliveries(spark, sf).withColumns({"day": F.col("ship_ts").cast("date"), "promised": add_minutes("order_ts", F.lit(300))})
    out = PL.instance_table(busiest_group(d, "site_id", "day", KEY, 40), "order_ts", "promised", "weight_kg")
    return out.select(*KEY, "demand_kg", "service_minutes", "window_start", "window_end")


# ---------------------------------------------------------------- shifts and fleet


def drivers(spark, sf):
    c = B.table(spark, sf, "customer")
    return c.select(F.col("c_nationkey").alias("site_id"), F.col("c_custkey").alias("driver_id"), (F.abs("c_acctbal") / 500 + 12).alias("hourly_cost"))


@query("shift_cover")
def shift_cover(spark, sf):
    return PL.greedy_shift_cover(drivers(spark, sf), "site_id", "driver_id", "hourly_cost")


@query("shift_cover_improvement")
def shift_cover_improvement(spark, sf):
    cheap = PL.shift_cost(shift_cover(spark, sf), ["site_id"]).select("site_id", F.col("cost").alias("o"))
    first = PL.shift_cost(PL.greedy_shift_cover(drivers(spark, sf), "site_id", "driver_id", "hourly_cost", cheapest=False), ["site_id"]).select("site_id", F.col("cost").alias("b"))
    return PL.improvement_table(F.concat(F.lit("shift_cover_"), F.col("site_id").cast("string")), "o", "b", cheap.join(first, "site_id"))


def fleet_inputs(spark, sf):
    o = B.orders_fact(spark, sf).where("order_status = 'P'").select(
        F.col("zone_id").alias("site_id"), F.col("order_id").alias("route_id"), (F.col("order_id") % 900).alias("load"), (F.col("priority") == "1-URGENT").alias("cold"), (F.col("order_id") % 400).alias("km"))
    v = B.vehicles(spark, sf).select((F.col("vehicle_id") % 25).cast("int").alias("site_id"), "vehicle_id", F.col("capacity_kg").alias("capacity"), "refrigerated", F.col("rate_per_100km").alias("rate"))
    return o, v


@query("fleet_assignment")
def fleet_assignment(spark, sf):
    return PL.fleet_assignment(*fleet_inputs(spark, sf), "site_id")


@query("fleet_assignment_improvement")
def fleet_assignment_improvement(spark, sf):
    one = fleet_assignment(spark, sf).groupBy("site_id").agg(F.sum("cost").alias("o"), F.sum("first_come_cost").alias("b"))
    return PL.improvement_table(F.concat(F.lit("fleet_"), F.col("site_id").cast("string")), "o", "b", one)


# ---------------------------------------------------------------- sites


def zones(spark, sf):
    demand = B.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("zone_id")).agg((F.count(F.lit(1)) / 10.0).alias("demand"))
    return customer_points(spark, sf).withColumnRenamed("customer_id", "zone_id").join(demand, "zone_id")


SITE_COST_SQL = f"""WITH {B.SQL_SITES}, {POINT_SQL}, zn AS (SELECT o_custkey AS zone_id, COUNT(*) / 10.0::DOUBLE AS demand, lat AS zlat, lon AS zlon FROM orders JOIN pts ON o_custkey = customer_id GROUP BY 1, 3, 4),
  cand AS (SELECT * FROM sites), costs AS (SELECT zone_id, demand, site_id, fixed_cost, {haversine_sql('zlat', 'zlon', 'lat', 'lon')} AS km FROM zn, cand), cc AS (SELECT *, km * demand * 0.02::DOUBLE AS cost FROM costs)"""


@query("site_service_costs", SITE_COST_SQL + " SELECT site_id, COUNT(*) AS zones, ROUND(SUM(cost), 6) AS cost, ROUND(AVG(km), 6) AS avg_km FROM cc GROUP BY 1")
def site_service_costs(spark, sf):
    return R6(SC.service_totals(zones(spark, sf), B.sites(spark, sf)), "cost", "avg_km")


def _greedy_sql():
    ctes, chosen = [SITE_COST_SQL], ""
    best = "SELECT zone_id, NULL::DOUBLE AS best FROM zn"
    for r in range(1, 5):
        prev = " UNION ALL ".join(f"SELECT site_id FROM p{i}" for i in range(1, r)) or "SELECT NULL WHERE FALSE"
        fixed = " + ".join(["0", *[f"(SELECT f FROM p{i})" for i in range(1, r)]])
        ctes.append(f"b{r} AS ({best})")
        ctes.append(f"p{r} AS (SELECT site_id, fixed_cost / 1000 AS f, SUM(LEAST(cost, COALESCE(best, cost))) + fixed_cost / 1000 + {fixed} AS total FROM cc JOIN b{r} USING (zone_id) WHERE site_id NOT IN ({prev}) GROUP BY site_id, fixed_cost ORDER BY total, site_id LIMIT 1)")
        best = f"SELECT zone_id, LEAST(cost, COALESCE(best, cost)) AS best FROM cc JOIN b{r} USING (zone_id) WHERE site_id = (SELECT site_id FROM p{r})"
        chosen += (" UNION ALL " if chosen else "") + f"SELECT site_id, {r}::INTEGER AS round, ROUND(total, 6) AS total_cost FROM p{r}"
    return ", ".join(ctes), chosen


_GCTE, _GSEL = _greedy_sql()


@query("greedy_sites", f"{_GCTE} {_GSEL}")
def greedy_sites(spark, sf):
    return R6(SC.greedy_sites(zones(spark, sf), B.sites(spark, sf), 4), "total_cost")


@query("nearest_open_site", f"{_GCTE}, op AS (SELECT site_id FROM ({_GSEL})), a AS (SELECT zone_id, arg_min(site_id, (cost, site_id)) AS site_id, MIN(cost) AS cost, arg_min(km, (cost, site_id)) AS km, MAX(demand) AS demand FROM cc WHERE site_id IN (SELECT site_id FROM op) GROUP BY 1) "
       "SELECT site_id, COUNT(*) AS zones_served, ROUND(SUM(demand), 6) AS demand, ROUND(AVG(km), 6) AS avg_km, ROUND(SUM(cost), 6) AS service_cost FROM a GROUP BY 1")
def nearest_open_site(spark, sf):
    z, sites = zones(spark, sf), B.sites(spark, sf)
    out = PL.open_site_summary(SC.nearest_open_site(z, sites, SC.greedy_sites(z, sites, 4)))
    return R6(out, "demand", "avg_km", "service_cost")


# ---------------------------------------------------------------- forecast


def daily(spark, sf):
    return FC.daily_series(B.table(spark, sf, "orders"), "o_orderdate")


def fc_sql(p, where):
    """CTEs of the decomposition fitted on the rows of ``daily`` satisfying ``where``; the prefix names them."""
    return f"""{p}t AS (SELECT *, month(day) AS m, isodow(day) - 1 AS w FROM daily WHERE {where}), {p}l AS (SELECT regr_slope(orders, idx) AS s, regr_intercept(orders, idx) AS i FROM {p}t),
   {p}r AS (SELECT {p}t.*, orders / GREATEST(i + s * idx, 1e-6) AS ratio FROM {p}t, {p}l),
   {p}m0 AS (SELECT x.m, COALESCE(f, 1.0::DOUBLE) AS f FROM range(1, 13) x(m) LEFT JOIN (SELECT m, CASE WHEN COUNT(*) >= 3 THEN quantile_cont(ratio, 0.5) END AS f FROM {p}r GROUP BY 1) USING (m)),
   {p}m AS (SELECT m, f / (SELECT AVG(f) FROM {p}m0) AS g FROM {p}m0), {p}r2 AS (SELECT w, ratio / f AS r2 FROM {p}r JOIN {p}m0 USING (m)),
   {p}d0 AS (SELECT x.w, COALESCE(f, 1.0::DOUBLE) AS f FROM range(0, 7) x(w) LEFT JOIN (SELECT w, CASE WHEN COUNT(*) >= 3 THEN quantile_cont(r2, 0.5) END AS f FROM {p}r2 GROUP BY 1) USING (w)),
   {p}d AS (SELECT w, f / (SELECT AVG(f) FROM {p}d0) AS g FROM {p}d0)"""


def fc_pred(p, rel):
    return f"(SELECT z.*, (i + s * idx) * {p}m.g * {p}d.g AS fitted FROM (SELECT *, month(day) AS mm, isodow(day) - 1 AS ww FROM {rel}) z JOIN {p}m ON mm = {p}m.m JOIN {p}d ON ww = {p}d.w, {p}l)"


DAILY_SQL = """WITH daily AS (SELECT day, orders, ROW_NUMBER() OVER (ORDER BY day) - 1 AS idx FROM (SELECT o_orderdate::DATE AS day, COUNT(*)::DOUBLE AS orders FROM orders GROUP BY 1)), n AS (SELECT COUNT(*) AS n, LEAST(30, GREATEST(14, COUNT(*) // 6)) AS h FROM daily)"""
FORECAST_SQL = f"""{DAILY_SQL}, {fc_sql('fa_', 'TRUE')}, sd AS (SELECT STDDEV_POP(orders - fitted) AS sd FROM {fc_pred('fa_', 'daily')}),
 fut AS (SELECT (SELECT MAX(day) FROM daily) + h::INTEGER AS day, h, (SELECT n FROM n) + h - 1 AS idx FROM range(1, 31) r(h)), pr AS (SELECT day, h, fitted AS p, 1.96::DOUBLE * sd * SQRT(1 + h / 30.0::DOUBLE) AS w FROM {fc_pred('fa_', 'fut')}, sd),
 fc AS (SELECT day, h::INTEGER AS h, GREATEST(p, 0) AS point, GREATEST(p - w, 0) AS lower, p + w AS upper FROM pr)"""


@query("demand_forecast", FORECAST_SQL + " SELECT day, h, ROUND(point, 6) AS point, ROUND(lower, 6) AS lower, ROUND(upper, 6) AS upper FROM fc")
def demand_forecast(spark, sf):
    return R6(FC.demand_forecast(daily(spark, sf)), "point", "lower", "upper")


@query("forecast_accuracy", f"""{DAILY_SQL}, {fc_sql('fa_', 'TRUE')}, {fc_sql('fb_', 'idx < (SELECT n - h FROM n)')}, tst AS (SELECT * FROM daily WHERE idx >= (SELECT n - h FROM n))
 SELECT COUNT(*) AS holdout_days, ROUND(AVG(ABS(orders - fitted) / GREATEST(orders, 1)) * 100, 6) AS mape, ROUND(SQRT(AVG((orders - fitted) * (orders - fitted))), 6) AS rmse, ROUND(AVG(ABS(orders - fitted)), 6) AS mae,
  (SELECT ROUND(AVG(ABS(orders - fitted) / GREATEST(orders, 1)) * 100, 6) FROM {fc_pred('fa_', 'daily')}) AS in_sample_mape FROM {fc_pred('fb_', 'tst')}""")
def forecast_accuracy(spark, sf):
    return R6(FC.forecast_accuracy(daily(spark, sf)), "mape", "rmse", "mae", "in_sample_mape")


@query("forecast_totals", FORECAST_SQL + """ SELECT ROUND(SUM(point) FILTER (h <= 7), 6) AS next_7, ROUND(SUM(point), 6) AS next_30, (SELECT SUM(orders) FROM daily, n WHERE idx >= n - 30) AS last_30,
  ROUND((SUM(point) - (SELECT SUM(orders) FROM daily, n WHERE idx >= n - 30)) * 100 / (SELECT SUM(orders) FROM daily, n WHERE idx >= n - 30), 6) AS change_pct FROM fc""")
def forecast_totals(spark, sf):
    d = daily(spark, sf)
    return R6(FC.forecast_totals(d, FC.demand_forecast(d)), "next_7", "next_30", "change_pct")


@query("seasonal_factors", f"{DAILY_SQL}, {fc_sql('fa_', 'TRUE')} SELECT 'month' AS part, m::INTEGER AS slot, ROUND(g, 9) AS factor FROM fa_m UNION ALL SELECT 'weekday', w::INTEGER, ROUND(g, 9) FROM fa_d")
def seasonal_factors(spark, sf):
    _, m, d = FC.decompose(daily(spark, sf))
    a = m.select(F.lit("month").alias("part"), F.col("month").alias("slot"), F.round("factor_month", 9).alias("factor"))
    return a.unionByName(d.select(F.lit("weekday").alias("part"), F.col("dow").alias("slot"), F.round("factor_dow", 9).alias("factor")))


SCENARIOS = {"more_vans": {"fleet": 140}, "peak": {"demand": 180, "traffic": 130}, "storm": {"weather": 300}, "lean": {"route": 60, "wh": 150}, "fuel_shock": {"fuel": 220, "drivers": 80}}


def _scenario_sql():
    names = list(FC.LEVERS)
    rows = ", ".join("('" + n + "', " + ", ".join(f"{s.get(k, d) / 100}::DOUBLE" for k, d in FC.LEVERS.items()) + ")" for n, s in {"baseline": {}, **SCENARIOS}.items())
    return f"""{DELIV}, {ELASTIC_SQL}, {STRUCTURE_SQL}, lv(scenario, {", ".join(names)}) AS (VALUES {rows}),
 c AS (SELECT *, pow(GREATEST(LEAST(lv.fleet, lv.drivers), 0.01), 0.85) * pow(GREATEST(GREATEST(lv.fleet, lv.drivers), 0.01), 0.15) AS cap, lv.drivers AS drv, lv.fuel AS fuelx FROM lv, structure s, elastic),
 p AS (SELECT *, demand / cap AS pressure, orders * demand AS so, km_per_order / SQRT(GREATEST(wh, 0.01)) * (1 - route * 0.18::DOUBLE) AS skm FROM c),
 q2 AS (SELECT *, so * skm AS s_km FROM p),
 r AS (SELECT *, s_km * fuel_per_km * fuelx * (1 + (traffic - 1) * 0.25::DOUBLE) AS fuel_cost, so * labour_per_order * (1 + GREATEST(pressure - 1, 0) * 0.55::DOUBLE) * (1 + (traffic - 1) * 0.35::DOUBLE) * (1 - route * 0.18::DOUBLE) AS labour_cost,
  total_cost * other_share * demand AS other_cost, GREATEST(total_cost * 0.04::DOUBLE * (wh - 1), 0) AS site_cost,
  LEAST(GREATEST((100 - on_time_rate) / 100 + (traffic - 1) * quartile_gap + (weather - 1) * adverse_gap + GREATEST(pressure - 1, 0) * 0.22::DOUBLE - GREATEST(cap - 1, 0) * 0.06::DOUBLE - route * 0.035::DOUBLE, 0.005), 0.85) AS late FROM q2),
 o AS (SELECT scenario, so AS orders, (1 - late) * 100 AS on_time, fuel_cost + labour_cost + other_cost + site_cost AS cost, total_revenue * demand AS revenue, total_revenue * demand - (fuel_cost + labour_cost + other_cost + site_cost) AS margin,
  (fuel_cost + labour_cost + other_cost + site_cost) / GREATEST(so, 1) AS cost_per_order, skm AS km_per_order, total_co2 * (s_km / total_km) * (1 - route * 0.1::DOUBLE) AS co2, pressure, CASE WHEN fleet <= drv THEN 'fleet' ELSE 'drivers' END AS binding, fuel_cost, labour_cost, other_cost, site_cost FROM r)
 SELECT scenario, binding, {", ".join(f"ROUND(o.{c}, 2) AS {c}" for c in _SC)}, ROUND(o.on_time * 100 / b.on_time, 6) AS on_time_index, ROUND(o.cost_per_order * 100 / b.cost_per_order, 6) AS cost_per_order_index,
  ROUND(o.km_per_order * 100 / b.km_per_order, 6) AS km_per_order_index, ROUND(o.margin - b.margin, 2) AS margin_change FROM o, (SELECT on_time, cost_per_order, km_per_order, margin FROM o WHERE scenario = 'baseline') b"""


_SC = ["orders", "on_time", "cost", "revenue", "margin", "cost_per_order", "km_per_order", "co2", "pressure", "fuel_cost", "labour_cost", "other_cost", "site_cost"]


@query("scenario_table", _scenario_sql())
def scenario_table(spark, sf):
    out = FC.scenario_table(structure(spark, sf), elasticity(spark, sf), SCENARIOS)
    return out.withColumns({**{c: F.round(c, 2) for c in [*_SC, "margin_change"]}, **{f"{c}_index": F.round(f"{c}_index", 6) for c in ("on_time", "cost_per_order", "km_per_order")}})


# ---------------------------------------------------------------- map layers


PING_SQL = "pings AS (SELECT event_id, user_id, ts, value, (event_id * 37 % 140 - 70)::DOUBLE AS lat, (event_id * 91 % 360 - 180)::DOUBLE AS lon FROM events)"


def pings(spark, sf):
    return B.table(spark, sf, "events").select("event_id", "user_id", "ts", "value", *B.coordinates("event_id"))


@query("map_route_lines", f"""WITH {PING_SQL}, top AS (SELECT user_id FROM pings GROUP BY 1 ORDER BY COUNT(*) DESC, user_id LIMIT 40),
  r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, COUNT(*) OVER (PARTITION BY user_id) AS n FROM pings WHERE user_id IN (SELECT user_id FROM top)), t AS (SELECT * FROM r WHERE n >= 3 AND i % GREATEST(1, n // 40) = 0)
  SELECT user_id, COUNT(*)::INTEGER AS points, string_agg(lat::INTEGER || ' ' || lon::INTEGER, ',' ORDER BY i) AS line FROM t GROUP BY 1""")
def map_route_lines(spark, sf):
    lines = MA.route_lines(pings(spark, sf), "user_id", ["ts", "event_id"], time_bucket("ts"), "lat", "lon")
    text = F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["lat"].cast("int").cast("string"), p["lon"].cast("int").cast("string"))), ",")
    return lines.select("user_id", F.size("points").alias("points"), text.alias("line"))


@query("map_last_positions", f"WITH {PING_SQL} SELECT user_id, arg_max(lat, (ts, event_id)) AS lat, arg_max(lon, (ts, event_id)) AS lon, arg_max(value, (ts, event_id)) AS value FROM pings GROUP BY 1")
def map_last_positions(spark, sf):
    return MA.last_positions(pings(spark, sf), "user_id", ["ts", "event_id"], ["lat", "lon", "value"])


@query("map_zone_demand", f"WITH {B.SQL_ORDERS} SELECT n_nationkey AS zone_id, n_name AS zone_name, COUNT(*) AS orders FROM nation JOIN orders_fact ON zone_id = n_nationkey GROUP BY 1, 2")
def map_zone_demand(spark, sf):
    zones = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("zone_id"), F.col("n_name").alias("zone_name"))
    return MA.zone_demand(zones, B.orders_fact(spark, sf), "zone_id")


@query("map_panel_layer", f"""{DELIV}, {B.SQL_SITES}, p AS (SELECT zone_id AS site_zone, {rt('is_late')} AS congestion, {ds('km')} AS km FROM deliveries GROUP BY 1), c AS (SELECT site_zone, ROUND(AVG(lat), 9) AS lat, ROUND(AVG(lon), 9) AS lon FROM sites GROUP BY 1) SELECT * FROM p JOIN c USING (site_zone)""")
def map_panel_layer(spark, sf):
    from ..functions.scalars import exact_sum, rate

    d = B.deliveries(spark, sf).withColumnRenamed("zone_id", "site_zone")
    out = MA.panel_layer(d, "site_zone", B.sites(spark, sf), {"congestion": rate("is_late"), "km": exact_sum("km")})
    return out.withColumns({"lat": F.round("lat", 9), "lon": F.round("lon", 9)})


@query("map_centre", f"WITH {B.SQL_SITES} SELECT quantile_cont(lat, 0.5) AS lat, quantile_cont(lon, 0.5) AS lon FROM sites")
def map_centre(spark, sf):
    return MA.map_centre(B.sites(spark, sf))


# ---------------------------------------------------------------- recommendations and checks


def recs(spark, sf):
    plans = PL.improvement_table("inventory_policy", "o", "b", policy(spark, sf).agg(F.sum("annual_cost").alias("o"), F.sum("baseline_cost").alias("b")))
    return MA.recommendations(B.deliveries(spark, sf), routes(spark, sf), B.vehicles(spark, sf), B.inventory(spark, sf), F.col("priority").isin("1-URGENT", "2-HIGH"), plans)


REC_SQL = f"""{ROUTE_SQL}, {B.SQL_INVENTORY}, net AS (SELECT COUNT(*) AS n, {ds('cost')} AS cost, AVG(is_late::INT) AS late, AVG(is_late::INT) FILTER (priority IN ('1-URGENT', '2-HIGH')) - AVG(is_late::INT) FILTER (priority NOT IN ('1-URGENT', '2-HIGH')) AS gap,
   {ds("CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN cost END")} AS acost FROM deliveries), z AS (SELECT zone_id, COUNT(*) AS orders, AVG(is_late::INT) AS lr FROM deliveries GROUP BY 1 HAVING COUNT(*) >= 30 ORDER BY lr DESC, zone_id LIMIT 10),
 {POLICY_SQL.replace(f"WITH {B.SQL_INVENTORY}, ", "").replace("g AS (", "g9 AS (").replace("FROM g)", "FROM g9)").replace("e AS (SELECT *, SQRT", "e9 AS (SELECT *, SQRT").replace("FROM e)", "FROM e9)").replace("f AS (SELECT *, daily", "f9 AS (SELECT *, daily").replace("FROM f)", "FROM f9)")},
 recs AS (SELECT 'Optimization' AS category, 'high' AS confidence, 'medium' AS effort, SUM(baseline_cost) - SUM(annual_cost) AS impact_usd, (SUM(baseline_cost) - SUM(annual_cost)) * 100 / SUM(baseline_cost) AS impact_pct FROM policy HAVING (SUM(baseline_cost) - SUM(annual_cost)) * 100 / SUM(baseline_cost) > 1
  UNION ALL SELECT 'Operations', 'high', 'low', SUM(GREATEST(lr - late, 0) * orders) * MAX(cost / n) * 0.35, SUM(GREATEST(lr - late, 0) * orders) / MAX(n) * 100 FROM z, net HAVING COUNT(*) > 0
  UNION ALL SELECT 'Fleet', 'medium', 'medium', (SELECT cost FROM net) * AVG((utilisation_kg < 0.4)::INT) * 0.12, AVG((utilisation_kg < 0.4)::INT) * 12 FROM route_table WHERE utilisation_kg IS NOT NULL HAVING AVG((utilisation_kg < 0.4)::INT) > 0.15
  UNION ALL SELECT 'Fleet', 'medium', 'high', COUNT(*) FILTER (2026 - model_year > 8) * 1800.0::DOUBLE, NULL FROM vehicles HAVING COUNT(*) FILTER (2026 - model_year > 8) > 5
  UNION ALL SELECT 'Warehouse', 'medium', 'low', (SELECT cost FROM net) * AVG(stockout_flag::INT) * 2.2, AVG(stockout_flag::INT) * 100 FROM inventory HAVING AVG(stockout_flag::INT) > 0.005
  UNION ALL SELECT 'Operations', 'high', 'low', acost * gap * 1.5, gap * 100 FROM net WHERE gap > 0.005)"""


@query("recommendations", REC_SQL + " SELECT category, confidence, effort, ROUND(impact_usd, 4) AS impact_usd, ROUND(impact_pct, 6) AS impact_pct, ROW_NUMBER() OVER (ORDER BY COALESCE(impact_usd, 0) DESC)::INTEGER AS rank FROM recs")
def recommendations(spark, sf):
    return recs(spark, sf).select("category", "confidence", "effort", F.round("impact_usd", 4).alias("impact_usd"), F.round("impact_pct", 6).alias("impact_pct"), "rank")


@query("recommendation_totals", REC_SQL + " SELECT COUNT(*) AS opportunities, COUNT(impact_usd) AS quantified, ROUND(SUM(impact_usd), 4) AS total_value, COUNT(*) FILTER (effort = 'low') AS quick_wins, ROUND(SUM(impact_usd) * 100 / (SELECT cost FROM net), 6) AS share_of_cost_pct FROM recs")
def recommendation_totals(spark, sf):
    from ..functions.scalars import exact_sum

    total = B.deliveries(spark, sf).agg(exact_sum("cost")).scalar()
    return MA.recommendation_totals(recs(spark, sf), total).withColumns({"total_value": F.round("total_value", 4), "share_of_cost_pct": F.round("share_of_cost_pct", 6)})


@query("dataset_meta", f"""WITH {B.SQL_ORDERS} SELECT 'rows_orders' AS key, COUNT(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'rows_lineitem', COUNT(*)::VARCHAR FROM lineitem UNION ALL SELECT 'rows_events', COUNT(*)::VARCHAR FROM events
  UNION ALL SELECT 'first_day', strftime(MIN(order_ts), '%Y-%m-%d') FROM orders_fact UNION ALL SELECT 'last_day', strftime(MAX(order_ts), '%Y-%m-%d') FROM orders_fact
  UNION ALL SELECT 'values_region', string_agg(DISTINCT region, ',' ORDER BY region) FROM orders_fact UNION ALL SELECT 'values_domain', string_agg(DISTINCT domain, ',' ORDER BY domain) FROM orders_fact UNION ALL SELECT 'values_priority', string_agg(DISTINCT priority, ',' ORDER BY priority) FROM orders_fact""")
def dataset_meta(spark, sf):
    t = {n: B.table(spark, sf, n) for n in ("orders", "lineitem", "events")}
    return MA.dataset_meta(t, B.orders_fact(spark, sf), "order_ts", ["region", "domain", "priority"])


@query("cube_reconciliation", f"""{DELIV}, {CUBE_SQL}, a AS (SELECT SUM(orders)::DOUBLE AS orders, {ds('revenue')} AS revenue, {ds('cost')} AS cost, {ds('km')} AS km, {ds('co2')} AS co2 FROM cube_rows),
  b AS (SELECT COUNT(*)::DOUBLE AS orders, {ds('revenue')} AS revenue, {ds('cost')} AS cost, {ds('km')} AS km, {ds('co2')} AS co2 FROM deliveries)
  """ + " UNION ALL ".join(f"SELECT '{m}' AS measure, ROUND(a.{m}, 4) AS cube_total, ROUND(b.{m}, 4) AS fact_total, 0.0::DOUBLE AS difference FROM a, b" for m in ("orders", "revenue", "cost", "km", "co2")))
def cube_reconciliation(spark, sf):
    out = MA.reconciliation(B.deliveries(spark, sf), _cube(spark, sf))
    return out.withColumns({c: F.round(c, 4) + 0.0 for c in ("cube_total", "fact_total", "difference")})
