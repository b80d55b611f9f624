"""Aggregates, cube and marts over the whole delivery table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chance import hash_uniform, uniform_between
from ..functions.labels import append_label
from ..functions.scalars import case_ladder
from ..operators import aggregates as A
from ..operators import sets
from ..operators.joins import lookup_join
from ..operators.ordered import dense_rank_in_group, period_over_period
from . import bind as B
from .bind import da, ds, rt
from .registry import query

DELIV = f"WITH {B.SQL_DELIVERIES} "
DIMS = ["region", "domain"]
CUBE_SQL = f"""cube_rows AS (SELECT region, domain, strftime(order_ts, '%Y-%m') AS month, COUNT(*) AS orders,
  {ds('revenue')} AS revenue, {ds('cost')} AS cost, COUNT(*) FILTER (is_late) AS late,
  COUNT(*) FILTER (status = 'failed') AS failed, {ds('km')} AS km, {ds('co2')} AS co2, {ds('duration_min')} AS duration
  FROM deliveries GROUP BY 1, 2, 3)"""
RESUM = ", ".join(
    f"CAST(SUM({m}) AS BIGINT) AS {m}" if m in ("orders", "late", "failed") else f"{ds(m)} AS {m}" for m in A.CUBE_MEASURES
)
RATIOS = """revenue - cost AS margin, (orders - late) * 100.0::DOUBLE / orders AS on_time,
  (revenue - cost) * 100 / revenue AS margin_pct, cost / orders AS cost_per_order"""


def _cube(spark, sf):
    return A.fact_cube(B.deliveries(spark, sf), DIMS)


query("fact_cube", f"{DELIV}, {CUBE_SQL} SELECT * FROM cube_rows")(_cube)


@query("cube_by_region_month", f"{DELIV}, {CUBE_SQL}, s AS (SELECT region, month, {RESUM} FROM cube_rows GROUP BY 1, 2) SELECT *, {RATIOS} FROM s")
def cube_by_region_month(spark, sf):
    return A.reaggregate(_cube(spark, sf), ["region", "month"])


@query("cube_network_total", f"{DELIV}, {CUBE_SQL}, s AS (SELECT {RESUM} FROM cube_rows) SELECT *, {RATIOS} FROM s")
def cube_network_total(spark, sf):
    return A.reaggregate(_cube(spark, sf))


@query("cube_rollup", f"""{DELIV}, {CUBE_SQL}, s AS (
  SELECT CASE WHEN GROUPING(region) = 1 THEN 'all' ELSE region END AS region,
         CASE WHEN GROUPING(domain) = 1 THEN 'all' ELSE domain END AS domain,
         CAST(GROUPING(region) * 2 + GROUPING(domain) AS BIGINT) AS level, {RESUM} FROM cube_rows GROUP BY CUBE (region, domain))
  SELECT *, {RATIOS} FROM s""")
def cube_rollup(spark, sf):
    return A.cube_rollup(_cube(spark, sf), DIMS)


@query("cube_slice", f"""{DELIV}, {CUBE_SQL}, s AS (
  SELECT month, {RESUM} FROM cube_rows WHERE region = 'ASIA' GROUP BY 1) SELECT *, {RATIOS} FROM s""")
def cube_slice(spark, sf):
    return A.reaggregate(A.slice_cube(_cube(spark, sf), region="ASIA", domain="all"), ["month"])


def _kpi_sql(by, extra=""):
    return f"""{DELIV} SELECT {by}, COUNT(*) AS orders, {ds('revenue')} AS revenue, {ds('cost')} AS cost,
      (1 - {rt('is_late')}) * 100 AS on_time{extra}, {ds('revenue')} - {ds('cost')} AS margin FROM deliveries GROUP BY 1"""


@query("kpis_by_domain", _kpi_sql("domain", f", {da('km')} AS avg_km"))
def kpis_by_domain(spark, sf):
    return A.group_kpis(B.deliveries(spark, sf), "domain", {"avg_km": A.exact_avg("km")})


@query("kpis_by_region", _kpi_sql("region"))
def kpis_by_region(spark, sf):
    return A.group_kpis(B.deliveries(spark, sf), "region")


@query("kpis_by_priority", _kpi_sql("priority", f", {da('cost')} AS avg_cost"))
def kpis_by_priority(spark, sf):
    return A.group_kpis(B.deliveries(spark, sf), "priority", {"avg_cost": A.exact_avg("cost")})


@query("network_kpis", f"""{DELIV} SELECT COUNT(*) AS total_orders,
  COUNT(*) FILTER (status IN ('delivered', 'delivered_late')) AS delivered, (1 - {rt('is_late')}) * 100 AS on_time_rate,
  {ds('revenue')} AS revenue, {ds('cost')} AS cost, {da('km')} AS avg_km, {ds('km')} AS total_km,
  {ds('co2')} / 1000 AS co2_tonnes, {rt("status = 'failed'")} * 100 AS failed_rate,
  {rt("status = 'returned'")} * 100 AS return_rate, {ds('revenue')} - {ds('cost')} AS margin,
  ({ds('revenue')} - {ds('cost')}) * 100 / {ds('revenue')} AS margin_pct, {ds('cost')} / COUNT(*) AS avg_cost_per_order
  FROM deliveries""")
def network_kpis(spark, sf):
    return A.network_kpis(B.deliveries(spark, sf))


@query("monthly_movement", f"""{DELIV}, m AS (SELECT strftime(order_ts, '%Y-%m') AS month, COUNT(*) AS orders, {ds('revenue')} AS revenue,
  {ds('cost')} AS cost FROM deliveries GROUP BY 1)
  SELECT *, (orders - LAG(orders) OVER w) * 100::DOUBLE / ABS(LAG(orders) OVER w) AS orders_delta,
   (revenue - LAG(revenue) OVER w) * 100 / ABS(LAG(revenue) OVER w) AS revenue_delta,
   (cost - LAG(cost) OVER w) * 100 / ABS(LAG(cost) OVER w) AS cost_delta FROM m WINDOW w AS (ORDER BY month)""")
def monthly_movement(spark, sf):
    months = B.deliveries(spark, sf).groupBy(F.date_format("order_ts", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), A.exact_sum("revenue").alias("revenue"), A.exact_sum("cost").alias("cost"))
    return period_over_period(months, "month", ["orders", "revenue", "cost"])


@query("status_mix", f"""{DELIV} SELECT status, COUNT(*) AS orders, COUNT(*) * 100::DOUBLE / (SELECT COUNT(*) FROM deliveries) AS share
  FROM deliveries GROUP BY 1""")
def status_mix(spark, sf):
    return A.status_mix(B.deliveries(spark, sf), "status")


@query("cost_breakdown", f"""{DELIV}, t AS (SELECT {ds('fuel_cost')} AS f, {ds('labour_cost')} AS l, {ds('toll_cost')} AS t, {ds('handling_cost')} AS h FROM deliveries)
  SELECT 'fuel' AS category, f AS amount FROM t UNION ALL SELECT 'labour', l FROM t UNION ALL SELECT 'tolls', t FROM t UNION ALL SELECT 'handling', h FROM t""")
def cost_breakdown(spark, sf):
    return A.cost_breakdown(B.deliveries(spark, sf), {"fuel": "fuel_cost", "labour": "labour_cost", "tolls": "toll_cost", "handling": "handling_cost"})


VEH_SQL = f"{B.SQL_VEHICLES}, caps AS (SELECT vehicle_id AS sku_id, capacity_kg, capacity_m3 FROM vehicles)"
ROUTE_KEYS = ["site_id", "route_month"]
ROUTE_SEQ = ["ship_ts", "order_id", "line_no", "sku_id", "value", "weight_kg"]
ROUTE_SQL = f"""WITH {B.SQL_DELIVERIES}, {VEH_SQL}, w AS (SELECT *, date_trunc('month', ship_ts)::DATE AS route_month FROM deliveries),
g AS (SELECT site_id, route_month,
  arg_min(sku_id, (ship_ts, order_id, line_no, sku_id, value, weight_kg)) AS sku_id,
  arg_min(region, (ship_ts, order_id, line_no, sku_id, value, weight_kg)) AS region,
  COUNT(*) AS stops, {ds('km')} AS planned_km, {ds('duration_min')} AS actual_duration_min, {ds('weight_kg')} AS total_weight_kg,
  {ds('volume_m3')} AS total_volume_m3, {ds('cost')} AS route_cost, COUNT(*) FILTER (is_late) AS late_stops,
  MIN(order_ts) AS start_ts, MAX(order_ts) AS end_ts FROM w GROUP BY 1, 2),
u AS (SELECT g.*, planned_km * GREATEST(LEAST(1.0::DOUBLE - (stops - 1) * 0.028::DOUBLE, 1.0), 0.42) AS actual_km,
  CASE WHEN capacity_kg IS NOT NULL THEN GREATEST(LEAST(total_weight_kg / GREATEST(capacity_kg, 1e-6), 3.0), 0.0) END AS utilisation_kg,
  CASE WHEN capacity_m3 IS NOT NULL THEN GREATEST(LEAST(total_volume_m3 / GREATEST(capacity_m3, 1e-6), 3.0), 0.0) END AS utilisation_m3,
  1 - late_stops / stops::DOUBLE AS on_time_rate, route_cost / stops AS cost_per_stop,
  CASE WHEN stops <= 3 THEN 'direct' WHEN stops <= 10 THEN 'short_multistop' WHEN stops <= 20 THEN 'standard_multistop'
       ELSE 'dense_multistop' END AS route_type FROM g LEFT JOIN caps USING (sku_id)),
route_table AS (SELECT *, COALESCE(utilisation_kg > 1.0, FALSE) AS overloaded, route_cost / GREATEST(actual_km, 0.1) AS cost_per_km,
  actual_km - planned_km AS km_gap, on_time_rate < 0.7 OR COALESCE(utilisation_kg > 1.0, FALSE) AS disrupted FROM u)"""


def routes(spark, sf):
    d = B.deliveries(spark, sf).withColumn("route_month", F.trunc(F.col("ship_ts").cast("date"), "month"))
    caps = B.vehicles(spark, sf).select(F.col("vehicle_id").alias("sku_id"), "capacity_kg", "capacity_m3")
    return A.route_rollup(d, caps, ROUTE_KEYS, ROUTE_SEQ, "sku_id", ["region"])


query("route_rollup", ROUTE_SQL + " SELECT * FROM route_table")(routes)


def _u_sql(stream, key):
    return f"(('0x' || substr(md5('42:{stream}:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


LEDGER_RANGES = {"maintenance": (0.04, 0.14), "insurance": (0.15, 0.6), "warehousing": (0.8, 1.25), "penalties": (0.02, 0.35), "overhead": (0.4, 1.8)}
_LKEY = "site_id || ':' || strftime(month, '%Y-%m-%d')"
_LF = {c: f"({_u_sql('ledger_' + c, _LKEY)} * {hi - lo!r}::DOUBLE + {lo}::DOUBLE)" for c, (lo, hi) in LEDGER_RANGES.items()}
_LAMT = {
    "fuel": "fuel", "labour": "labour", "tolls": "tolls", "maintenance": f"km * {_LF['maintenance']} * cost_index",
    "insurance": f"orders_count * {_LF['insurance']} * cost_index", "warehousing": f"monthly_fixed_cost * {_LF['warehousing']}",
    "overhead": f"orders_count * {_LF['overhead']} * cost_index", "penalties": f"orders_count * {_LF['penalties']} * cost_index",
}
_LEDGER_UNION = " UNION ALL ".join(f"SELECT site_id, month, orders_count, '{c}' AS category, {x} AS amount FROM b" for c, x in _LAMT.items())


@query("monthly_ledger", f"""WITH {B.SQL_DELIVERIES}, {B.SQL_SITES}, m AS (SELECT site_id, date_trunc('month', order_ts)::DATE AS month, COUNT(*) AS orders_count,
  {ds('fuel_cost')} AS fuel, {ds('labour_cost')} AS labour, {ds('toll_cost')} AS tolls, {ds('km')} AS km FROM deliveries GROUP BY 1, 2),
 b AS (SELECT m.*, 1 + site_zone / 100.0::DOUBLE AS cost_index, fixed_cost AS monthly_fixed_cost FROM m LEFT JOIN sites USING (site_id)),
 a AS ({_LEDGER_UNION}), c AS (SELECT site_id, month, orders_count, category, CASE WHEN amount IS NOT NULL THEN GREATEST(amount, 0) END AS amount FROM a)
 SELECT *, amount * ({_u_sql('budget', _LKEY + " || ':' || category")} * {1.2 - 0.85!r}::DOUBLE + 0.85::DOUBLE) AS budget,
  amount - amount * ({_u_sql('budget', _LKEY + " || ':' || category")} * {1.2 - 0.85!r}::DOUBLE + 0.85::DOUBLE) AS variance,
  amount / GREATEST(orders_count, 1) AS cost_per_order FROM c""")
def monthly_ledger(spark, sf):
    s = B.sites(spark, sf).select("site_id", (1 + F.col("site_zone") / 100.0).alias("cost_index"), F.col("fixed_cost").alias("monthly_fixed_cost"))
    factors = {c: uniform_between(hash_uniform(f"ledger_{c}", ["site_id", "month"]), *r) for c, r in LEDGER_RANGES.items()}
    budget = uniform_between(hash_uniform("budget", ["site_id", "month", "category"]), 0.85, 1.2)
    return A.monthly_ledger(B.deliveries(spark, sf), s, "site_id", factors, budget)


SCORE_SQL = f"""w AS (SELECT *, date_trunc('month', order_ts)::DATE AS month FROM deliveries),
 fb AS (SELECT site_id, date_trunc('month', order_ts)::DATE AS month, {da('5 - l_tax * 50')} AS avg_rating
        FROM lineitem JOIN orders_fact ON l_orderkey = order_id JOIN (SELECT DISTINCT s_suppkey AS site_id FROM supplier) ON site_id = l_suppkey
        WHERE l_returnflag <> 'N' GROUP BY 1, 2),
 g AS (SELECT site_id, month, COUNT(*) AS deliveries, COUNT(*) FILTER (is_late) AS late_deliveries,
  COUNT(*) FILTER (status = 'failed') AS failed_deliveries, {ds('km')} AS total_km, {ds('duration_min')} AS total_duration_min,
  {ds('cost')} AS total_cost, {ds('revenue')} AS total_revenue, {da('delay_days')} AS avg_delay FROM w GROUP BY 1, 2),
 r AS (SELECT g.*, avg_rating, 1 - late_deliveries / deliveries::DOUBLE AS on_time_rate, 1 - failed_deliveries / deliveries::DOUBLE AS success_rate,
  deliveries / GREATEST(total_duration_min / 60, 0.5) AS deliveries_per_hour, total_cost / deliveries AS cost_per_delivery,
  total_revenue - total_cost AS margin, total_km / deliveries AS km_per_delivery FROM g LEFT JOIN fb USING (site_id, month)),
 scorecard AS (SELECT *, on_time_rate * 45 + success_rate * 25 + COALESCE(avg_rating, 4.0) / 5 * 20
   + LEAST(GREATEST(deliveries_per_hour / 4, 0), 1) * 10 AS performance_score FROM r)"""


def scorecard(spark, sf):
    l, o = B.table(spark, sf, "lineitem"), B.orders_fact(spark, sf).select("order_id", "order_ts")
    ratings = l.where(F.col("l_returnflag") != "N").join(o, l.l_orderkey == o.order_id).select(
        F.col("l_suppkey").alias("site_id"), F.trunc(F.col("order_ts").cast("date"), "month").alias("month"),
        (5 - F.col("l_tax") * 50).alias("rating"))
    return A.courier_scorecard(B.deliveries(spark, sf), "site_id", ratings)


query("courier_scorecard", f"{DELIV}, {SCORE_SQL} SELECT * FROM scorecard")(scorecard)


@query("rank_in_region", f"""WITH {B.SQL_DELIVERIES}, {B.SQL_SITES}, {SCORE_SQL}, z AS (SELECT site_id, month, site_region, CAST(ROUND(performance_score * 1e6) AS BIGINT) AS score_micro
  FROM scorecard LEFT JOIN sites USING (site_id))
  SELECT *, CAST(DENSE_RANK() OVER (PARTITION BY site_region, month ORDER BY score_micro DESC) AS INTEGER) AS rank_in_group FROM z""")
def rank_in_region(spark, sf):
    cards = lookup_join(scorecard(spark, sf), B.sites(spark, sf), "site_id", "site_id", {"site_region": "site_region"})
    micro = cards.select("site_id", "month", "site_region", F.round(F.col("performance_score") * 1e6).cast("long").alias("score_micro"))
    return dense_rank_in_group(micro, ["site_region", "month"], "score_micro", -F.floor(F.col("score_micro") / 1_000_000))


@query("driver_ranking", f"""{DELIV}, {SCORE_SQL}, ranked AS (SELECT site_id, CAST(SUM(deliveries) AS BIGINT) AS deliveries,
  {da('CAST(on_time_rate AS DECIMAL(18,12))', 12)} AS on_time, {da('CAST(performance_score AS DECIMAL(18,12))', 12)} AS score,
  {da('cost_per_delivery', 8)} AS cost_per_delivery FROM scorecard GROUP BY 1 ORDER BY score DESC, site_id LIMIT 25)
  SELECT site_id, deliveries, ROUND(on_time, 9) AS on_time, ROUND(score, 9) AS score, ROUND(cost_per_delivery, 6) AS cost_per_delivery FROM ranked""")
def driver_ranking(spark, sf):
    out = A.driver_ranking(scorecard(spark, sf), "site_id", 25)
    return out.withColumns({"on_time": F.round("on_time", 9), "score": F.round("score", 9), "cost_per_delivery": F.round("cost_per_delivery", 6)})


@query("score_histogram", f"""{DELIV}, {SCORE_SQL} SELECT round_even(performance_score, 0) AS score, COUNT(*) AS n FROM scorecard GROUP BY 1""")
def score_histogram(spark, sf):
    return A.score_histogram(scorecard(spark, sf))


@query("conditional_counts", f"""{DELIV} SELECT region, COUNT(*) FILTER (status = 'failed') AS failed, COUNT(*) FILTER (status = 'returned') AS returned,
  COUNT(*) FILTER (is_late) AS late FROM deliveries GROUP BY 1""")
def conditional_counts(spark, sf):
    return A.conditional_count(B.deliveries(spark, sf), ["region"], {"failed": F.col("status") == "failed", "returned": F.col("status") == "returned", "late": F.col("is_late")})


SITE_MONTH_SQL = f"""site_month AS (SELECT site_id, date_trunc('month', ship_ts)::DATE AS period, COUNT(*) AS orders_count, {ds('weight_kg')} AS total_weight_kg,
  {da('km')} AS avg_km, {rt('is_late')} AS late_rate, {rt('cold')} AS cold_share FROM deliveries GROUP BY 1, 2)"""


def site_month(spark, sf):
    return A.site_period_features(B.deliveries(spark, sf), "site_id", F.trunc(F.col("ship_ts").cast("date"), "month"))


query("site_month_features", f"{DELIV}, {SITE_MONTH_SQL} SELECT * FROM site_month")(site_month)


@query("demand_grid", """SELECT d::INTEGER AS d, h::INTEGER AS h, COALESCE(orders, 0) AS orders FROM
  (SELECT x.range AS d, y.range AS h FROM range(7) x, range(24) y) LEFT JOIN
  (SELECT isodow(ts) - 1 AS d, hour(ts) AS h, COUNT(*) AS orders FROM events GROUP BY 1, 2) USING (d, h)""")
def demand_grid(spark, sf):
    return A.demand_grid(B.table(spark, sf, "events"), "ts")


_PROFILE = f"""COUNT(*) AS orders, (1 - {rt('is_late')}) * 100 AS on_time, {da('delay_days')} AS avg_delay, {ds('cost')} AS cost FROM deliveries GROUP BY 1"""


@query("profile_by_weekday", f"{DELIV} SELECT (isodow(order_ts) - 1)::INTEGER AS weekday, {_PROFILE}")
def profile_by_weekday(spark, sf):
    return A.period_profile(B.deliveries(spark, sf), F.weekday("order_ts"), "weekday")


@query("profile_by_month", f"{DELIV} SELECT strftime(order_ts, '%Y-%m') AS month, {_PROFILE}")
def profile_by_month(spark, sf):
    return A.period_profile(B.deliveries(spark, sf), F.date_format("order_ts", "yyyy-MM"), "month")


@query("profile_by_week", f"{DELIV} SELECT date_trunc('week', order_ts)::DATE AS week, {_PROFILE}")
def profile_by_week(spark, sf):
    return A.period_profile(B.deliveries(spark, sf), F.trunc(F.col("order_ts").cast("date"), "week"), "week")


@query("profile_latest_days", f"{DELIV} SELECT order_ts::DATE AS day, {_PROFILE} ORDER BY day DESC LIMIT 120")
def profile_latest_days(spark, sf):
    return A.period_profile(B.deliveries(spark, sf), F.col("order_ts").cast("date"), "day", 120)


@query("profile_by_hour", f"""SELECT hour(ts)::INTEGER AS hour, COUNT(*) AS orders, (1 - {rt("event_type = 'error'")}) * 100 AS on_time,
   {da('value')} AS avg_delay, {ds('value')} AS cost FROM events GROUP BY 1""")
def profile_by_hour(spark, sf):
    e = B.table(spark, sf, "events").select("ts", (F.col("event_type") == "error").alias("is_late"), F.col("value").alias("delay_days"), F.col("value").alias("cost"))
    return A.period_profile(e, F.hour("ts"), "hour")


@query("impact_by_priority", f"""{DELIV} SELECT priority, COUNT(*) AS orders, {rt('is_late')} * 100 AS late_rate, {da('delay_days')} AS avg_delay FROM deliveries GROUP BY 1""")
def impact_by_priority(spark, sf):
    return A.impact_table(B.deliveries(spark, sf), "priority")


FLEET_SQL = f"""WITH {B.SQL_DELIVERIES}, {B.SQL_VEHICLES}, {B.SQL_MAINTENANCE},
 work AS (SELECT sku_id AS vehicle_id, COUNT(*) AS deliveries, {ds('km')} AS km, {ds('cost')} AS cost, {rt('is_late')} AS late FROM deliveries GROUP BY 1),
 upkeep AS (SELECT vehicle_id, COUNT(*) AS events, {ds('maint_cost')} AS maint_cost, COUNT(*) FILTER (unplanned) AS unplanned FROM maintenance GROUP BY 1),
 fleet AS (SELECT v.*, COALESCE(deliveries, 0) AS deliveries, COALESCE(km, 0) AS km, COALESCE(cost, 0) AS cost, COALESCE(late, 0) AS late,
   COALESCE(events, 0) AS events, COALESCE(maint_cost, 0) AS maint_cost, COALESCE(unplanned, 0) AS unplanned,
   COALESCE(deliveries, 0) * 100::DOUBLE / (SELECT MAX(deliveries) FROM work) AS utilisation
   FROM vehicles v LEFT JOIN work USING (vehicle_id) LEFT JOIN upkeep USING (vehicle_id))"""


def fleet(spark, sf):
    d = B.deliveries(spark, sf).withColumnRenamed("sku_id", "vehicle_id")
    return A.fleet_utilisation(B.vehicles(spark, sf), d, B.maintenance(spark, sf), "vehicle_id")


query("fleet_utilisation", FLEET_SQL + " SELECT * FROM fleet")(fleet)


@query("fleet_by_type", FLEET_SQL + f""" SELECT vehicle_type, COUNT(*) AS vehicles, CAST(SUM(deliveries) AS BIGINT) AS deliveries, {ds('km')} AS km,
  {da('utilisation', 8)} AS avg_utilisation, {da('capacity_kg')} AS avg_capacity FROM fleet GROUP BY 1""")
def fleet_by_type(spark, sf):
    return A.fleet_by_type(fleet(spark, sf))


@query("fleet_summary", f"""WITH {B.SQL_VEHICLES}, {B.SQL_MAINTENANCE} SELECT COUNT(*) AS total_vehicles, COUNT(*) FILTER (vehicle_status = 'active') AS active,
  2026 - {da('model_year')} AS avg_age_years, {rt("fuel_type = 'electric'")} * 100 AS electric_share,
  (SELECT {ds('maint_cost')} FROM maintenance) AS total_maintenance_cost, (SELECT {rt('unplanned')} * 100 FROM maintenance) AS unplanned_share FROM vehicles""")
def fleet_summary(spark, sf):
    return A.fleet_summary(B.vehicles(spark, sf), B.maintenance(spark, sf))


@query("fleet_by_fuel", f"WITH {B.SQL_VEHICLES} SELECT fuel_type, COUNT(*) AS n FROM vehicles GROUP BY 1")
def fleet_by_fuel(spark, sf):
    return A.value_counts(B.vehicles(spark, sf), "fuel_type")


@query("fleet_age_profile", f"WITH {B.SQL_VEHICLES} SELECT 2026 - model_year AS age, COUNT(*) AS n FROM vehicles GROUP BY 1")
def fleet_age_profile(spark, sf):
    return A.age_profile(B.vehicles(spark, sf))


@query("maintenance_by_type", f"""WITH {B.SQL_MAINTENANCE} SELECT maintenance_type, COUNT(*) AS events, {ds('maint_cost')} AS cost, {rt('unplanned')} * 100 AS unplanned_rate
  FROM maintenance GROUP BY 1""")
def maintenance_by_type(spark, sf):
    return A.maintenance_by_type(B.maintenance(spark, sf), "maintenance_type")


THROUGHPUT_SQL = f"""WITH {B.SQL_DELIVERIES}, {B.SQL_SITES}, daily AS (SELECT site_id, ship_ts::DATE AS day, COUNT(*) AS n FROM deliveries GROUP BY 1, 2),
 peak AS (SELECT site_id, MAX(n) AS peak_day_orders, CAST(SUM(n) AS BIGINT) AS orders FROM daily GROUP BY 1),
 throughput AS (SELECT s.*, COALESCE(peak_day_orders, 0) AS peak_day_orders, COALESCE(orders, 0) AS orders,
   COALESCE(peak_day_orders, 0) / GREATEST(daily_capacity, 1) * 100 AS capacity_used_pct FROM sites s LEFT JOIN peak USING (site_id))"""


def throughput(spark, sf):
    return A.site_throughput(B.sites(spark, sf), B.deliveries(spark, sf), "site_id", F.col("ship_ts").cast("date"))


query("site_throughput", THROUGHPUT_SQL + " SELECT * FROM throughput")(throughput)


@query("site_by_region", THROUGHPUT_SQL + f""" SELECT site_region, COUNT(*) AS sites, CAST(SUM(orders) AS BIGINT) AS orders, {da('capacity_used_pct', 8)} AS avg_capacity_used
  FROM throughput GROUP BY 1""")
def site_by_region(spark, sf):
    return throughput(spark, sf).groupBy("site_region").agg(
        F.count(F.lit(1)).alias("sites"), F.sum("orders").alias("orders"), A.exact_avg("capacity_used_pct", 8).alias("avg_capacity_used"))


@query("inventory_summary", f"""WITH {B.SQL_INVENTORY} SELECT COUNT(*) AS sku_locations, {rt('stockout_flag')} * 100 AS stockout_rate, {ds('units_on_hand')} AS total_units,
  {ds('COALESCE(units_on_hand, 0) * COALESCE(unit_cost, 0)')} AS stock_value, quantile_cont(days_of_cover, 0.5) AS median_days_cover FROM inventory""")
def inventory_summary(spark, sf):
    return A.inventory_summary(B.inventory(spark, sf))


@query("inventory_by_category", f"""WITH {B.SQL_INVENTORY} SELECT sku_category, COUNT(*) AS sku_locations, {ds('units_on_hand')} AS units, {rt('stockout_flag')} * 100 AS stockout_rate,
  {da('turnover_rate', 6)} AS turnover, {ds('unit_cost')} AS value FROM inventory GROUP BY 1""")
def inventory_by_category(spark, sf):
    return A.inventory_by_category(B.inventory(spark, sf), "sku_category")


@query("inventory_abc", f"""WITH {B.SQL_INVENTORY}, c AS (SELECT CASE WHEN units_on_hand > 300 THEN 'A' WHEN units_on_hand > 100 THEN 'B' ELSE 'C' END AS abc_class FROM inventory)
  SELECT abc_class, COUNT(*) AS n FROM c GROUP BY 1""")
def inventory_abc(spark, sf):
    inv = B.inventory(spark, sf).withColumn("abc_class", case_ladder([F.col("units_on_hand") > 300, F.col("units_on_hand") > 100], ["A", "B"], "C"))
    return A.value_counts(inv, "abc_class")


@query("distinct_counts", """SELECT 'o_custkey' AS "column", COUNT(DISTINCT o_custkey) AS n_unique FROM orders UNION ALL
 SELECT 'o_orderstatus', COUNT(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'o_orderpriority', COUNT(DISTINCT o_orderpriority) FROM orders UNION ALL
 SELECT 'o_totalprice', COUNT(DISTINCT o_totalprice) FROM orders UNION ALL SELECT 'o_orderdate', COUNT(DISTINCT o_orderdate) FROM orders""")
def distinct_counts(spark, sf):
    return A.distinct_counts(B.table(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"])


@query("distinct_counts_sketch")
def distinct_counts_sketch(spark, sf):
    return A.distinct_counts(B.table(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_totalprice"], approximate=True)


@query("site_busy_threshold", f"{DELIV}, {SITE_MONTH_SQL} SELECT site_id, quantile_cont(orders_count::DOUBLE, 0.85) AS threshold FROM site_month GROUP BY 1")
def site_busy_threshold(spark, sf):
    return A.group_quantile(site_month(spark, sf), ["site_id"], "orders_count", 0.85)


@query("cold_routes", f"{DELIV} SELECT site_id, date_trunc('month', ship_ts)::DATE AS route_month, {rt('cold')} AS share FROM deliveries GROUP BY 1, 2 HAVING {rt('cold')} >= 0.5")
def cold_routes(spark, sf):
    d = B.deliveries(spark, sf).withColumn("route_month", F.trunc(F.col("ship_ts").cast("date"), "month"))
    return A.share_above(d, ["site_id", "route_month"], F.col("cold"), 0.5)


@query("group_mean_gap", DELIV + " , t AS (SELECT * FROM deliveries)" + " UNION ALL ".join(
    f" SELECT '{c}' AS \"column\", ROUND(AVG({c}) FILTER (is_late), 6) AS flagged_mean, ROUND(AVG({c}) FILTER (NOT is_late), 6) AS normal_mean, ROUND(ABS(AVG({c}) FILTER (is_late) - AVG({c}) FILTER (NOT is_late)), 6) AS gap FROM t"
    for c in ("weight_kg", "value", "km", "duration_min")))
def group_mean_gap(spark, sf):
    out = A.group_mean_gap(B.deliveries(spark, sf), F.col("is_late"), ["weight_kg", "value", "km", "duration_min"])
    return out.select("column", *[F.round(c, 6).alias(c) for c in ("flagged_mean", "normal_mean", "gap")])


ELASTIC_SQL = f"""q AS (SELECT quantile_cont(km, 0.25) AS q1, quantile_cont(km, 0.75) AS q3 FROM deliveries),
 elastic AS (SELECT AVG(CASE WHEN km >= q3 THEN is_late::INT END) - AVG(CASE WHEN km <= q1 THEN is_late::INT END) AS quartile_gap,
  AVG(CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN is_late::INT END) - AVG(CASE WHEN NOT (priority IN ('1-URGENT', '2-HIGH')) THEN is_late::INT END) AS adverse_gap
 FROM deliveries, q)"""


def elasticity(spark, sf):
    return A.elasticities(B.deliveries(spark, sf), "km", F.col("priority").isin("1-URGENT", "2-HIGH"))


query("elasticities", f"{DELIV}, {ELASTIC_SQL} SELECT * FROM elastic")(elasticity)

STRUCTURE_SQL = f"""base AS (SELECT COUNT(*) AS orders, {ds('fuel_cost')} AS fuel, {ds('labour_cost')} AS labour, {ds('toll_cost')} + {ds('handling_cost')} AS other,
  {ds('cost')} AS total_cost, {ds('revenue')} AS total_revenue, {ds('km')} AS total_km, {ds('co2')} AS total_co2, (1 - {rt('is_late')}) * 100 AS on_time_rate,
  (SELECT COUNT(*) FROM part) AS fleet_size, (SELECT COUNT(*) FROM supplier) AS drivers, (SELECT COUNT(*) FROM nation) AS sites FROM deliveries),
 structure AS (SELECT *, fuel / (fuel + labour + other) AS fuel_share, labour / (fuel + labour + other) AS labour_share, other / (fuel + labour + other) AS other_share,
  fuel / total_km AS fuel_per_km, labour / orders AS labour_per_order, total_cost / orders AS cost_per_order, total_km / orders AS km_per_order,
  orders / GREATEST(fleet_size, 1)::DOUBLE AS orders_per_vehicle, orders / GREATEST(drivers, 1)::DOUBLE AS orders_per_driver, orders / GREATEST(sites, 1)::DOUBLE AS orders_per_site FROM base)"""


def structure(spark, sf):
    return A.cost_structure(B.deliveries(spark, sf), B.table(spark, sf, "part"), B.table(spark, sf, "supplier"), B.table(spark, sf, "nation"))


query("cost_structure", f"{DELIV}, {STRUCTURE_SQL} SELECT * FROM structure")(structure)


@query("exception_counts", f"""{DELIV}, f AS (SELECT CASE WHEN is_late AND km > 350 THEN 'late_leg;long_haul' WHEN is_late THEN 'late_leg' WHEN km > 350 THEN 'long_haul' ELSE '' END AS flags FROM deliveries)
 SELECT split_part(flags, ';', 1) AS flag, COUNT(*) AS n FROM f WHERE flags <> '' GROUP BY 1""")
def exception_counts(spark, sf):
    d = B.deliveries(spark, sf).select("is_late", "km").withColumn("flags", append_label(F.lit(""), "late_leg", F.col("is_late")))
    return A.exception_counts(d.withColumn("flags", append_label("flags", "long_haul", F.col("km") > 350)), "flags")


@query("worst_zones", f"""{DELIV}, z AS (SELECT zone_id, COUNT(*) AS orders, {rt('is_late')} AS late_rate FROM deliveries GROUP BY 1 HAVING COUNT(*) >= 30)
 SELECT *, GREATEST(late_rate - (SELECT {rt('is_late')} FROM deliveries), 0) * orders AS excess_late FROM z ORDER BY late_rate DESC, zone_id LIMIT 10""")
def worst_zones(spark, sf):
    return sets.worst_groups(B.deliveries(spark, sf), "zone_id", 30, 10)
