"""Projections, joins, ordered operators, top-k, set operations, scalar functions and spines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import chance, geo, labels
from ..functions import scalars as S
from ..operators import joins as J
from ..operators import ordered as W
from ..operators import physics as P
from ..operators import sets as T
from ..operators import spines as G
from . import bind as B
from .bind import ds, rt
from .registry import query

DELIV = f"WITH {B.SQL_DELIVERIES}"
KEY = B.DELIVERY_KEY
KEYS = ", ".join(KEY)


def u_sql(stream, *keys, seed=42):
    """SQL twin of ``hash_uniform``."""
    text = " || ':' || ".join([f"'{seed}:{stream}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def clip_sql(x, lo, hi):
    return f"CASE WHEN ({x}) IS NOT NULL THEN LEAST(GREATEST({x}, {lo}), {hi}) END"


def haversine_sql(lat1, lon1, lat2, lon2):
    h = (f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
         f"pow(sin(radians({lon2} - {lon1}) / 2), 2)")
    return f"(asin(sqrt(LEAST(GREATEST({h}, 0.0), 1.0))) * 2 * 6371.0088::DOUBLE)"


# ---------------------------------------------------------------- projections and predicates


@query("distance_buckets", f"""{DELIV} SELECT CASE WHEN km <= 5 THEN '<5km' WHEN km <= 15 THEN '5-15km' WHEN km <= 40 THEN '15-40km'
  WHEN km <= 100 THEN '40-100km' WHEN km <= 300 THEN '100-300km' WHEN km IS NOT NULL THEN '>300km' END AS distance_bucket,
  COUNT(*) AS orders, {ds('cost')} AS cost FROM deliveries GROUP BY 1""")
def distance_buckets(spark, sf):
    d = B.deliveries(spark, sf).select(S.bucketize("km", [5, 15, 40, 100, 300], unit="km").alias("distance_bucket"), "cost")
    return d.groupBy("distance_bucket").agg(F.count(F.lit(1)).alias("orders"), S.exact_sum("cost").alias("cost"))


@query("distance_bands", f"""{DELIV} SELECT CASE WHEN km <= 10 THEN 'to_10' WHEN km <= 25 THEN 'to_25' WHEN km <= 50 THEN 'to_50'
  WHEN km <= 100 THEN 'to_100' ELSE 'more' END AS band, COUNT(*) AS orders, (1 - {rt('is_late')}) * 100 AS on_time FROM deliveries GROUP BY 1""")
def distance_bands(spark, sf):
    band = S.bucketize("km", [10, 25, 50, 100], ["to_10", "to_25", "to_50", "to_100", "more"])
    return B.deliveries(spark, sf).groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("orders"), ((1 - S.rate("is_late")) * 100).alias("on_time"))


@query("package_ladder", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < 5 THEN 'envelope' WHEN l_quantity < 20 THEN 'small_box'
  WHEN l_quantity < 40 THEN 'medium_box' ELSE 'large_box' END AS package_type FROM lineitem""")
def package_ladder(spark, sf):
    q = F.col("l_quantity")
    ladder = S.case_ladder([q < 5, q < 20, q < 40], ["envelope", "small_box", "medium_box"], "large_box")
    return B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ladder.alias("package_type"))


PRIORITY_FACTOR = {"1-URGENT": 0.25, "2-HIGH": 0.5, "3-MEDIUM": 1.0, "4-NOT SPECIFIED": 1.0}


@query("sla_factor_lookup", """SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0.25::DOUBLE WHEN '2-HIGH' THEN 0.5 WHEN '3-MEDIUM' THEN 1.0
  WHEN '4-NOT SPECIFIED' THEN 1.0 ELSE 1.6 END AS sla_factor FROM orders""")
def sla_factor_lookup(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", S.map_lookup("o_orderpriority", PRIORITY_FACTOR, 1.6).alias("sla_factor"))


@query("clipped_measures", """SELECT event_id, CASE WHEN value IS NOT NULL THEN LEAST(GREATEST(value, 5.0), 100.0) END AS clipped,
  CASE WHEN nullif(value, 6.55) IS NOT NULL THEN GREATEST(nullif(value, 6.55), 5.0) END AS null_kept FROM events""")
def clipped_measures(spark, sf):
    return B.table(spark, sf, "events").select("event_id", S.clip("value", 5.0, 100.0).alias("clipped"), S.clip(F.nullif("value", F.lit(6.55)), 5.0).alias("null_kept"))


@query("condition_flags", """SELECT event_id, event_type IN ('error', 'signup') AS is_adverse, hour(ts) BETWEEN 8 AND 18 AS is_business_hours,
  hour(ts) >= 21 OR hour(ts) < 5 AS is_night_shift, hour(ts) IN (8, 9, 17, 18) AS is_peak_hour FROM events""")
def condition_flags(spark, sf):
    parts = cal.calendar_parts("ts")
    return B.table(spark, sf, "events").select(
        "event_id", S.isin_flag("event_type", ["error", "signup"]).alias("is_adverse"), S.between_flag(F.hour("ts"), 8, 18).alias("is_business_hours"),
        parts["is_night_shift"].alias("is_night_shift"), parts["is_peak_hour"].alias("is_peak_hour"))


@query("leakage_guard", """SELECT l_linenumber, l_quantity, l_discount FROM lineitem""")
def leakage_guard(spark, sf):
    l = B.table(spark, sf, "lineitem").select(
        "l_linenumber", "l_quantity", "l_discount", F.col("l_orderkey").alias("order_id"), F.lit("").alias("anomaly_flags"),
        F.col("l_extendedprice").alias("delivery_cost_usd"), F.lit(0).alias("delivery_cost_usd__was_missing"),
        (F.col("l_returnflag") == "R").cast("int").alias("target_will_be_returned"))
    return P.drop_columns(l)


@query("known_targets_only", "SELECT event_id, nullif(value, 6.55) AS target FROM events WHERE nullif(value, 6.55) IS NOT NULL")
def known_targets_only(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", F.nullif("value", F.lit(6.55)).alias("target"))
    return P.filter_known_target(e, "target")


@query("efficiency_ratios", f"""{DELIV} SELECT {KEYS}, cost / GREATEST(km, 0.1) AS cost_per_km, cost / GREATEST(weight_kg, 0.01) AS cost_per_kg,
  (revenue - cost) / GREATEST(revenue, 0.01) AS margin_pct, km / GREATEST(duration_min / 60, 0.0167) AS speed_kmh, co2 / GREATEST(km, 0.1) AS co2_per_km,
  value / GREATEST(weight_kg, 0.01) AS value_per_kg, weight_kg / GREATEST(volume_m3, 0.0001) AS density FROM deliveries""")
def efficiency_ratios(spark, sf):
    d = B.deliveries(spark, sf).withColumns({"margin": F.col("revenue") - F.col("cost"), "hours": F.col("duration_min") / 60})
    ratios = P.efficiency_ratios({
        "cost_per_km": ("cost", "km", 0.1), "cost_per_kg": ("cost", "weight_kg", 0.01), "margin_pct": ("margin", "revenue", 0.01),
        "speed_kmh": ("km", "hours", 0.0167), "co2_per_km": ("co2", "km", 0.1), "value_per_kg": ("value", "weight_kg", 0.01),
        "density": ("weight_kg", "volume_m3", 0.0001)})
    return d.select(*KEY, *[c.alias(n) for n, c in ratios.items()])


TARGET_VIEW = """t AS (SELECT *, CASE WHEN status IN ('delivered', 'delivered_late') THEN ship_ts END AS actual_ts,
   CASE WHEN status IN ('delivered', 'delivered_late') THEN delay_days END AS delay,
   0.55::DOUBLE * COALESCE(CASE WHEN zone_id > 3 THEN zone_id / 25.0::DOUBLE END, 0) + 0.45::DOUBLE * COALESCE(CASE WHEN line_no < 6 THEN line_no / 10.0::DOUBLE END, 0.4::DOUBLE) AS env
  FROM deliveries)"""
RISK_SQL = f"""({clip_sql('COALESCE(delay, 0) / 120.0::DOUBLE', 0, 1)}) * 0.42::DOUBLE + env * 0.22::DOUBLE + 0.5::DOUBLE * 0.14::DOUBLE
  + (line_no = 1)::INT * 0.08::DOUBLE + cold::INT * 0.08::DOUBLE + (status IN ('failed', 'returned'))::INT * 0.30::DOUBLE"""


def with_targets(spark, sf):
    done = F.col("status").isin("delivered", "delivered_late")
    d = B.deliveries(spark, sf).withColumns({
        "actual_ts": F.when(done, F.col("ship_ts")), "delay": F.when(done, F.col("delay_days")),
        "severity": F.when(F.col("zone_id") > 3, F.col("zone_id") / 25.0), "congestion": F.when(F.col("line_no") < 6, F.col("line_no") / 10.0),
        "zone_difficulty": F.lit(None).cast("double"), "fragile": F.col("line_no") == 1,
    }).withColumn("env", P.environment_stress("severity", "congestion"))
    return P.add_targets(d, "delay", "actual_ts", "duration_min", "cost", "env", "zone_difficulty", "fragile", "cold", "status")


@query("targets", f"""{DELIV}, {TARGET_VIEW} SELECT {KEYS}, delay AS target_delay_minutes, CASE WHEN actual_ts IS NOT NULL THEN (COALESCE(delay > 0, FALSE))::INT::DOUBLE END AS target_is_late,
  duration_min AS target_eta_minutes, cost AS target_delivery_cost, ROUND({RISK_SQL}, 9) AS target_risk_score,
  CASE WHEN ROUND({RISK_SQL}, 9) <= 0.25 THEN 'low' WHEN ROUND({RISK_SQL}, 9) <= 0.5 THEN 'medium' ELSE 'high' END AS target_risk_bucket,
  (status = 'returned')::INT AS target_will_be_returned FROM t""")
def targets(spark, sf):
    t = with_targets(spark, sf).withColumn("target_risk_score", F.round("target_risk_score", 9))
    return t.select(*KEY, "target_delay_minutes", "target_is_late", "target_eta_minutes", "target_delivery_cost", "target_risk_score",
                    S.bucketize("target_risk_score", [0.25, 0.5], ["low", "medium", "high"]).alias("target_risk_bucket"), "target_will_be_returned")


@query("cost_model", f"""{DELIV}, c AS (SELECT {KEYS}, km * (zone_id % 9 + 6.0::DOUBLE) / 100.0::DOUBLE * 1.65::DOUBLE * (1 + zone_id / 100.0::DOUBLE) AS fuel_cost, duration_min / 60.0::DOUBLE * 18.0::DOUBLE AS labour_cost,
  toll_cost * (1 + zone_id / 100.0::DOUBLE) AS toll_cost, (weight_kg * 0.012::DOUBLE + line_no * 0.22::DOUBLE + cold::INT * 3.1::DOUBLE) * (1 + zone_id / 100.0::DOUBLE) AS handling_cost,
  km * (zone_id % 9 + 6.0::DOUBLE) / 100.0::DOUBLE * 2.68::DOUBLE AS co2_kg, revenue FROM deliveries)
  SELECT {KEYS}, ROUND(fuel_cost, 9) AS fuel_cost, ROUND(labour_cost, 9) AS labour_cost, ROUND(toll_cost, 9) AS toll_cost, ROUND(handling_cost, 9) AS handling_cost, ROUND(co2_kg, 9) AS co2_kg,
   ROUND(fuel_cost + labour_cost + toll_cost + handling_cost, 9) AS delivery_cost, ROUND(revenue - (fuel_cost + labour_cost + toll_cost + handling_cost), 9) AS margin FROM c""")
def cost_model(spark, sf):
    d = B.deliveries(spark, sf).withColumns({"l100": F.col("zone_id") % 9 + 6.0, "index": 1 + F.col("zone_id") / 100.0, "hourly": F.lit(18.0)})
    out = P.cost_model(d, "km", "l100", "index", "duration_min", "hourly", "toll_cost", "weight_kg", "line_no", "cold", "revenue")
    return out.select(*KEY, *[F.round(c, 9).alias(c) for c in ("fuel_cost", "labour_cost", "toll_cost", "handling_cost", "co2_kg", "delivery_cost", "margin")])


@query("travel_time_model", f"""{DELIV}, b AS (SELECT {KEYS}, km, CASE WHEN zone_id < 8 THEN 26.0::DOUBLE WHEN zone_id < 16 THEN 42.0 ELSE 63.0 END AS base, 1 + line_no / 20.0::DOUBLE AS traffic, 1 + zone_id / 60.0::DOUBLE AS weather,
   (site_id % 10) / 10.0::DOUBLE AS skill, 7.0::DOUBLE AS service, weight_kg * 0.35::DOUBLE AS handling FROM deliveries),
  s AS (SELECT *, LEAST(GREATEST(base / (traffic * weather) * (skill * 0.22::DOUBLE + 0.9::DOUBLE), 4.0), 110.0) AS speed FROM b)
  SELECT {KEYS}, ROUND(speed, 6) AS effective_speed, ROUND(km / speed * 60, 6) AS travel_minutes, ROUND(km / speed * 60 + service + handling, 6) AS actual_duration_min,
   ROUND(km / (base * 1.05::DOUBLE) * 60 + 7.0 + handling * 0.8::DOUBLE, 6) AS planned_duration_min FROM s""")
def travel_time_model(spark, sf):
    d = B.deliveries(spark, sf).withColumns({
        "area": S.case_ladder([F.col("zone_id") < 8, F.col("zone_id") < 16], ["urban", "suburban"], "rural"), "traffic": 1 + F.col("line_no") / 20.0,
        "weather": 1 + F.col("zone_id") / 60.0, "skill": F.col("site_id") % 10 / 10.0, "service": F.lit(7.0), "handling": F.col("weight_kg") * 0.35})
    out = P.travel_time_model(d, "area", "km", "traffic", "weather", "skill", "service", "handling")
    return out.select(*KEY, *[F.round(c, 6).alias(c) for c in ("effective_speed", "travel_minutes", "actual_duration_min", "planned_duration_min")])


@query("delivery_status", f"""WITH {B.SQL_ORDERS}, r AS (SELECT order_id, {u_sql('status', 'order_id')} AS u, zone_id / 25.0::DOUBLE AS difficulty, order_value > 250000 AS fragile, order_ts,
   order_ts + INTERVAL 1 DAY AS promised, order_ts + CAST(order_id % 2000 AS INTEGER) * INTERVAL 1 MINUTE AS completed FROM orders_fact),
  s AS (SELECT *, CASE WHEN u < (1 + difficulty) * 0.021::DOUBLE THEN 'failed' WHEN u < (1 + difficulty) * 0.021::DOUBLE + (1 + fragile::INT * 0.6::DOUBLE) * 0.014::DOUBLE THEN 'returned'
    WHEN u < (1 + difficulty) * 0.021::DOUBLE + (1 + fragile::INT * 0.6::DOUBLE) * 0.014::DOUBLE + 0.011::DOUBLE THEN 'cancelled' WHEN completed > promised THEN 'delivered_late' ELSE 'delivered' END AS status FROM r)
  SELECT order_id, status, CASE WHEN status IN ('delivered', 'delivered_late') THEN completed END AS actual_delivery_ts,
   CASE WHEN status IN ('delivered', 'delivered_late') THEN date_diff('second', promised, completed) / 60.0::DOUBLE END AS delay_minutes, status = 'delivered_late' AS is_late FROM s""")
def delivery_status(spark, sf):
    o = B.orders_fact(spark, sf).withColumns({"promised": cal.add_minutes("order_ts", F.lit(1440)), "completed": cal.add_minutes("order_ts", F.col("order_id") % 2000)})
    out = P.delivery_status(o, "completed", "promised", chance.hash_uniform("status", "order_id"), F.col("zone_id") / 25.0, F.col("order_value") > 250000)
    return out.select("order_id", "status", "actual_delivery_ts", "delay_minutes", "is_late")


@query("high_value_orders", "SELECT o_orderkey, o_totalprice, o_totalprice > (SELECT quantile_cont(o_totalprice, 0.9) FROM orders) AS is_high_value FROM orders")
def high_value_orders(spark, sf):
    return P.high_value_flag(B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("sla_calibration", """WITH r AS (SELECT o_orderkey, 24.0::DOUBLE AS sla, (o_orderkey % 2000)::DOUBLE AS completion FROM orders)
  SELECT o_orderkey, sla * GREATEST((SELECT quantile_cont(completion / GREATEST(sla * 60, 1), 0.885) FROM r), 1e-6) AS calibrated_sla_hours FROM r""")
def sla_calibration(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", F.lit(24.0).alias("sla"), (F.col("o_orderkey") % 2000).cast("double").alias("completion"))
    return P.sla_calibration(o, "completion", "sla").select("o_orderkey", "calibrated_sla_hours")


# ---------------------------------------------------------------- joins


@query("denormalised_orders", f"""WITH {B.SQL_ORDERS} SELECT order_id, region, domain, c_name AS customer_name, c_acctbal AS customer_balance, n_name AS zone_name
  FROM orders_fact LEFT JOIN customer ON customer_id = c_custkey LEFT JOIN nation ON zone_id = n_nationkey""")
def denormalised_orders(spark, sf):
    o = B.orders_fact(spark, sf).select("order_id", "customer_id", "zone_id", "region", "domain")
    o = J.lookup_join(o, B.table(spark, sf, "customer"), "customer_id", "c_custkey", {"c_name": "customer_name", "c_acctbal": "customer_balance"})
    return J.lookup_join(o, B.table(spark, sf, "nation"), "zone_id", "n_nationkey", {"n_name": "zone_name"}).drop("customer_id", "zone_id")


@query("salted_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, s_name AS site_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey")
def salted_lookup(spark, sf):
    l = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    return J.lookup_join(l, B.table(spark, sf, "supplier"), "l_suppkey", "s_suppkey", {"s_name": "site_name"}, salt=8)


@query("panel_floor_join", """WITH panel AS (SELECT event_type, date_trunc('day', ts) + INTERVAL (hour(ts) // 6 * 6) HOUR AS pts, AVG(CAST(value AS DECIMAL(18,4)))::DOUBLE AS v, SUM(CAST(value AS DECIMAL(18,4)))::DOUBLE / COUNT(value) AS avg_value
   FROM events GROUP BY 1, 2)
  SELECT event_id, COALESCE(avg_value, 0.0) AS panel_value FROM events e LEFT JOIN panel p ON e.event_type = p.event_type AND date_trunc('day', e.ts) + INTERVAL (hour(e.ts) // 6 * 6) HOUR = p.pts""")
def panel_floor_join(spark, sf):
    e = B.table(spark, sf, "events")
    panel = e.groupBy("event_type", cal.floor_time("ts", 6).alias("pts")).agg(S.exact_avg("value").alias("avg_value"))
    return J.grid_floor_join(e.select("event_id", "event_type", "ts"), panel, {"event_type": "event_type"}, "ts", "pts", 6, {"avg_value": ("panel_value", 0.0)}).select("event_id", "panel_value")


TEMPLATES = [(1, 1, "New Year", "global"), (12, 25, "Christmas", "christian"), (12, 26, "Boxing Day", "christian"), (5, 1, "Labour Day", "global"),
             (11, 11, "Singles Day", "APAC"), (11, 29, "Black Friday", "global"), (2, 29, "Leap Day", "global"), (12, 31, "New Year Eve", "global")]
AREA = {"AFRICA": "EMEA", "EUROPE": "EMEA", "MIDDLE EAST": "EMEA", "AMERICA": "NA", "ASIA": "APAC"}
HOLIDAY_SQL = """zones AS (SELECT n_name AS country, CASE r_name WHEN 'AMERICA' THEN 'NA' WHEN 'ASIA' THEN 'APAC' ELSE 'EMEA' END AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
 templates(m, d, holiday_name, scope) AS (VALUES """ + ", ".join(f"({m}, {d}, '{n}', '{s}')" for m, d, n, s in TEMPLATES) + """),
 hol AS (SELECT country, region, TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) AS date, holiday_name,
   CASE WHEN holiday_name IN ('Black Friday', 'Singles Day') THEN 'shopping_event' ELSE 'public_holiday' END AS holiday_type, holiday_name IN ('Black Friday', 'Singles Day') AS is_working_day
   FROM zones, templates, range(1995, 2002) t(y) WHERE (scope = 'global' OR scope = country OR scope = region OR (scope = 'christian' AND region IN ('EMEA', 'NA', 'LATAM')))),
 holidays AS (SELECT * FROM hol WHERE date >= DATE '1995-01-01' AND date < DATE '2001-09-01')"""


def holidays(spark, sf):
    zones = B.regions(spark, sf).select(F.col("n_name").alias("country"), S.map_lookup("r_name", AREA).alias("region"))
    return J.holiday_calendar(spark, TEMPLATES, zones, "1995-01-01", "2001-09-01")


query("holiday_calendar", f"WITH {HOLIDAY_SQL} SELECT * FROM holidays")(holidays)


@query("holiday_join", f"""WITH {B.SQL_ORDERS}, {HOLIDAY_SQL} SELECT order_id, holiday_type IS NOT NULL AS is_holiday,
  COALESCE(CASE holiday_type WHEN 'shopping_event' THEN 2.5::DOUBLE WHEN 'public_holiday' THEN 0.5 END, 1.0) AS holiday_demand_multiplier, COALESCE(holiday_type = 'shopping_event', FALSE) AS is_shopping_event
  FROM orders_fact JOIN nation ON zone_id = n_nationkey LEFT JOIN holidays h ON h.country = n_name AND h.date = order_ts::DATE""")
def holiday_join(spark, sf):
    o = J.lookup_join(B.orders_fact(spark, sf), B.table(spark, sf, "nation"), "zone_id", "n_nationkey", {"n_name": "country"}).select("order_id", "order_ts", "country")
    h = holidays(spark, sf).withColumn("demand_multiplier", F.when(F.col("holiday_type") == "shopping_event", 2.5).otherwise(0.5))
    return J.calendar_join(o, h, "country", "order_ts").drop("order_ts", "country")


@query("orphan_customers", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def orphan_customers(spark, sf):
    parents = B.table(spark, sf, "customer").where("c_acctbal > 0")
    return J.anti_join_orphans(B.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", parents, "c_custkey")


@query("orders_with_returns", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def orders_with_returns(spark, sf):
    back = B.table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return J.semi_join_members(B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", back, "l_orderkey")


@query("breakdown_history_flag", "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 45) AS had_breakdown FROM part")
def breakdown_history_flag(spark, sf):
    broken = B.table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 45")
    return J.flag_members(B.table(spark, sf, "part").select("p_partkey"), "p_partkey", broken, "l_partkey", "had_breakdown")


@query("site_orders_filled", """WITH w AS (SELECT l_suppkey AS site_id, COUNT(*) AS orders FROM lineitem WHERE l_quantity > 49.5 GROUP BY 1)
  SELECT s_suppkey AS site_id, COALESCE(orders, 0) AS orders FROM supplier LEFT JOIN w ON s_suppkey = site_id""")
def site_orders_filled(spark, sf):
    w = B.table(spark, sf, "lineitem").where("l_quantity > 49.5").groupBy(F.col("l_suppkey").alias("site_id")).agg(F.count(F.lit(1)).alias("orders"))
    return J.left_merge_fill(B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site_id")), w, "site_id", {"orders": 0})


@query("user_day_join", """WITH a AS (SELECT user_id, ts::DATE AS day, COUNT(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1, 2),
  b AS (SELECT user_id, ts::DATE AS day, COUNT(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1, 2) SELECT user_id, day, views, errors FROM a LEFT JOIN b USING (user_id, day)""")
def user_day_join(spark, sf):
    e = B.table(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    part = lambda kind, out: e.where(F.col("event_type") == kind).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias(out))
    return J.multi_key_left_join(part("view", "views"), part("error", "errors"), ["user_id", "day"])


@query("repeated_line_keys", "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def repeated_line_keys(spark, sf):
    return J.key_uniqueness(B.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


POINT_SQL = """pts AS (SELECT c_custkey AS customer_id, (c_custkey * 37 % 140 - 70)::DOUBLE AS lat, (c_custkey * 91 % 360 - 180)::DOUBLE AS lon FROM customer)"""


def customer_points(spark, sf):
    return B.table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), *B.coordinates("c_custkey"))


@query("nearest_sites", f"""WITH {B.SQL_SITES}, {POINT_SQL}, d AS (SELECT customer_id, site_id, {haversine_sql('p.lat', 'p.lon', 's.lat', 's.lon')} AS km FROM pts p, sites s),
  r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY km, site_id) AS rank FROM d),
  near AS (SELECT *, 'near' AS tier FROM r WHERE rank <= 3 AND km <= 1500), far AS (SELECT *, 'far' AS tier FROM r WHERE rank > 3 AND rank <= 6 AND km <= 3000),
  one AS (SELECT *, 'nearest' AS tier FROM r WHERE rank = 1 AND customer_id NOT IN (SELECT customer_id FROM near))
  SELECT customer_id, site_id, ROUND(km, 6) AS km, rank::INTEGER AS rank, tier FROM (SELECT * FROM near UNION ALL SELECT * FROM far UNION ALL SELECT * FROM one)""")
def nearest_sites(spark, sf):
    out = J.nearest_sites(customer_points(spark, sf), B.sites(spark, sf), "customer_id", "site_id", 3, 1500.0, 3000.0, 6)
    return out.withColumn("km", F.round("km", 6))


RUN_LEN = 12


def runs(spark, sf):
    d = B.deliveries(spark, sf).withColumn("month", F.trunc(F.col("ship_ts").cast("date"), "month"))
    return W.cluster_runs(d, ["site_id", "month"], ["ship_ts", "order_id", "line_no", "sku_id", "value", "weight_kg"], W.time_bucket("ship_ts"), RUN_LEN)


RUN_SQL = f"""runs AS (SELECT *, CAST(rn // {RUN_LEN} AS BIGINT) AS run_no, CAST(rn % {RUN_LEN} + 1 AS INTEGER) AS stop_sequence FROM (SELECT *, date_trunc('month', ship_ts)::DATE AS month,
  ROW_NUMBER() OVER (PARTITION BY site_id, date_trunc('month', ship_ts) ORDER BY ship_ts, order_id, line_no, sku_id, value, weight_kg) - 1 AS rn FROM deliveries))"""


@query("route_runs", f"{DELIV}, {RUN_SQL} SELECT {KEYS}, month, run_no, stop_sequence FROM runs")
def route_runs(spark, sf):
    return runs(spark, sf).select(*KEY, "month", "run_no", "stop_sequence")


@query("run_distances", f"""{DELIV}, {RUN_SQL}, p AS (SELECT site_id, month, run_no, stop_sequence, (customer_id * 37 % 140 - 70)::DOUBLE AS lat, (customer_id * 91 % 360 - 180)::DOUBLE AS lon FROM runs)
  SELECT a.site_id, a.month, a.run_no, COUNT(*) AS pairs, ROUND(SUM({haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}), 4) AS total_km, ROUND(MAX({haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}), 6) AS longest_km
  FROM p a JOIN p b ON a.site_id = b.site_id AND a.month = b.month AND a.run_no = b.run_no AND a.stop_sequence < b.stop_sequence GROUP BY 1, 2, 3""")
def run_distances(spark, sf):
    stops = runs(spark, sf).select("site_id", "month", "run_no", "stop_sequence", *B.coordinates("customer_id"))
    run = ["site_id", "month", "run_no"]
    legs = J.run_distances(stops, run, "stop_sequence", RUN_LEN)
    return legs.groupBy(*run).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("km"), 4).alias("total_km"), F.round(F.max("km"), 6).alias("longest_km"))


@query("cheapest_vehicle", f"""WITH {B.SQL_VEHICLES}, prof AS (SELECT capacity_kg AS capacity, refrigerated, rate_per_100km AS rate FROM vehicles GROUP BY 1, 2, 3),
  need AS (SELECT o_orderkey AS route_id, (o_orderkey % 1300)::DOUBLE AS load, o_orderpriority = '1-URGENT' AS cold, (o_orderkey % 400)::DOUBLE AS km FROM orders)
  SELECT route_id, load, cold, km, MIN(rate) AS rate, km * MIN(rate) / 100 + 25 AS cost FROM need LEFT JOIN prof ON capacity >= load AND (NOT cold OR refrigerated) GROUP BY 1, 2, 3, 4""")
def cheapest_vehicle(spark, sf):
    need = B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("route_id"), (F.col("o_orderkey") % 1300).cast("double").alias("load"),
        (F.col("o_orderpriority") == "1-URGENT").alias("cold"), (F.col("o_orderkey") % 400).cast("double").alias("km"))
    prof = J.vehicle_profiles(B.vehicles(spark, sf), "capacity_kg", "refrigerated", "rate_per_100km")
    return J.feasible_pairs(need, prof, "load", "cold", "km", band=50.0)


@query("event_window_tags", """WITH w AS (SELECT user_id AS place, ts AS start_ts, ts + INTERVAL 6 HOUR AS end_ts, event_id AS window_id FROM events WHERE event_type = 'error' AND value > 100)
  SELECT event_id, window_id FROM events JOIN w ON user_id = place AND ts BETWEEN start_ts AND end_ts""")
def event_window_tags(spark, sf):
    e = B.table(spark, sf, "events")
    w = e.where("event_type = 'error' AND value > 100").select(
        F.col("user_id").alias("place"), F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("interval 6 hours")).alias("end_ts"), F.col("event_id").alias("window_id"))
    return J.event_window_tag(e.select("event_id", "user_id", "ts"), w, "user_id", "ts").select("event_id", "window_id")


@query("ranking_agreement_inputs", """WITH a AS (SELECT p_brand AS feature, COUNT(*) AS score_a FROM part GROUP BY 1), b AS (SELECT p_brand AS feature, MAX(p_retailprice) AS score_b FROM part WHERE p_size > 10 GROUP BY 1)
  SELECT feature, score_a, score_b FROM a JOIN b USING (feature)""")
def ranking_agreement_inputs(spark, sf):
    p = B.table(spark, sf, "part").withColumnRenamed("p_brand", "feature")
    return J.inner_join_rankings(p.groupBy("feature").agg(F.count(F.lit(1)).alias("score_a")), p.where("p_size > 10").groupBy("feature").agg(F.max("p_retailprice").alias("score_b")))


# ---------------------------------------------------------------- ordered operators

EV = ["ts", "event_id"]
EW = "PARTITION BY user_id ORDER BY ts, event_id"


def events(spark, sf):
    return B.table(spark, sf, "events")


@query("prior_order_count", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS prior_count FROM orders")
def prior_order_count(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return W.prior_count(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], W.time_bucket("o_orderdate", 30 * W.DAY)).select("o_orderkey", "prior_count")


@query("prior_error_rate", f"SELECT event_id, AVG((event_type = 'error')::INT) OVER ({EW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_rate FROM events")
def prior_error_rate(spark, sf):
    return W.prior_rate(events(spark, sf), ["user_id"], EV, W.time_bucket("ts"), F.col("event_type") == "error").select("event_id", "prior_rate")


def _roll_sql(n, x="value"):
    w = f"OVER ({EW} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN COUNT({x}) {w} >= 3 THEN AVG({x}) {w} END"


@query("rolling_rows_mean", f"SELECT event_id, ROUND({_roll_sql(35)}, 9) AS roll35_mean, ROUND({_roll_sql(150)}, 9) AS roll150_mean FROM events")
def rolling_rows_mean(spark, sf):
    h = W.history_features(events(spark, sf), ["user_id"], EV, W.time_bucket("ts"), F.col("event_type") == "error", "value", prefix="u")
    return h.select("event_id", F.round("u_roll35_mean", 9).alias("roll35_mean"), F.round("u_roll150_mean", 9).alias("roll150_mean"))


@query("rolling_days_mean", """SELECT event_id, ROUND(CASE WHEN COUNT(value) OVER w >= 3 THEN AVG(value) OVER w END, 9) AS week_mean FROM (SELECT *, epoch(date_trunc('second', ts))::BIGINT AS s FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING)""")
def rolling_days_mean(spark, sf):
    return W.rolling_days_mean(events(spark, sf), ["user_id"], "ts", "value", 7, "week_mean").select("event_id", F.round("week_mean", 9).alias("week_mean"))


@query("value_lags", f"SELECT event_id, LAG(value, 1) OVER ({EW}) AS value_lag1, LAG(value, 2) OVER ({EW}) AS value_lag2, LAG(value, 7) OVER ({EW}) AS value_lag7 FROM events")
def value_lags(spark, sf):
    return W.lags(events(spark, sf), ["user_id"], EV, W.time_bucket("ts"), "value").select("event_id", "value_lag1", "value_lag2", "value_lag7")


@query("next_stockout_label", f"""WITH {B.SQL_INVENTORY} SELECT region, sku_id, snapshot_date, next_flag FROM (SELECT *, LEAD(stockout_flag) OVER (PARTITION BY region, sku_id ORDER BY snapshot_date) AS next_flag FROM inventory)
  WHERE next_flag IS NOT NULL""")
def next_stockout_label(spark, sf):
    inv = B.inventory(spark, sf)
    return W.lead_label(inv, ["region", "sku_id"], ["snapshot_date"], F.year("snapshot_date"), "stockout_flag").select("region", "sku_id", "snapshot_date", "next_flag")


@query("percentile_rank", "SELECT event_id, (RANK() OVER (ORDER BY value) + (COUNT(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE) / COUNT(*) OVER () AS pct_rank FROM events")
def percentile_rank(spark, sf):
    return W.pct_rank(events(spark, sf), "value").select("event_id", "pct_rank")


@query("price_index", "SELECT p_partkey, p_retailprice / AVG(p_retailprice) OVER (PARTITION BY p_type) AS price_index FROM part")
def price_index(spark, sf):
    return W.group_ratio(B.table(spark, sf, "part"), "p_retailprice", ["p_type"], "price_index").select("p_partkey", "price_index")


@query("latest_ping", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def latest_ping(spark, sf):
    return W.last_per_key(events(spark, sf), ["user_id"], EV, ["event_id", "value"])


@query("thinned_traces", f"""SELECT user_id, event_id, point FROM (SELECT user_id, event_id, ROW_NUMBER() OVER ({EW}) - 1 AS point, COUNT(*) OVER (PARTITION BY user_id) AS n FROM events)
  WHERE n >= 3 AND point % GREATEST(1, n // 40) = 0""")
def thinned_traces(spark, sf):
    return W.thin_trace(events(spark, sf), ["user_id"], EV, W.time_bucket("ts")).select("user_id", "event_id", "point")


@query("terminal_events", f"""SELECT event_id, i + 1 AS event_sequence, i / GREATEST(n - 1, 1)::DOUBLE AS progress, i = n - 1 AS is_terminal FROM
  (SELECT event_id, ROW_NUMBER() OVER ({EW}) - 1 AS i, COUNT(*) OVER (PARTITION BY user_id) AS n FROM events)""")
def terminal_events(spark, sf):
    return W.terminal_flag(events(spark, sf), ["user_id"], EV, W.time_bucket("ts")).select("event_id", "event_sequence", "progress", "is_terminal")


@query("flatline_runs", f"SELECT event_id, MAX((value > 200)::INT) OVER ({EW} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 1 AS in_run FROM events")
def flatline_runs(spark, sf):
    return W.run_tag(events(spark, sf), ["user_id"], EV, W.time_bucket("ts"), F.col("value") > 200, 4).select("event_id", "in_run")


SPEED_KM = haversine_sql("LAG(lat) OVER w", "LAG(lon) OVER w", "lat", "lon")


@query("implied_speed", f"""WITH p AS (SELECT event_id, user_id, ts, (event_id * 37 % 140 - 70) / 100.0::DOUBLE AS lat, (event_id * 91 % 360 - 180) / 100.0::DOUBLE AS lon FROM events),
  g AS (SELECT event_id, CASE WHEN LAG(lat) OVER w IS NOT NULL THEN {SPEED_KM} END AS km, date_diff('second', date_trunc('second', LAG(ts) OVER w), date_trunc('second', ts)) AS s FROM p WINDOW w AS ({EW}))
  SELECT event_id, ROUND(km, 6) AS leg_km, s AS leg_seconds, ROUND(km / (GREATEST(s, 1) / 3600.0::DOUBLE), 6) AS speed_kmh, COALESCE(km / (GREATEST(s, 1) / 3600.0::DOUBLE) > 200, FALSE) AS is_jump FROM g""")
def implied_speed(spark, sf):
    from ..operators.quality import implied_speed as op

    p = events(spark, sf).select("event_id", "user_id", "ts", ((F.col("event_id") * 37 % 140 - 70) / 100.0).alias("lat"), ((F.col("event_id") * 91 % 360 - 180) / 100.0).alias("lon"))
    out = op(p, ["user_id"], EV, W.time_bucket("ts"), "ts", "lat", "lon", 200.0)
    return out.select("event_id", F.round("leg_km", 6).alias("leg_km"), "leg_seconds", F.round("speed_kmh", 6).alias("speed_kmh"), "is_jump")


@query("cumulative_revenue_share", """WITH s AS (SELECT l_partkey, SUM(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS qty FROM lineitem GROUP BY 1),
  c AS (SELECT l_partkey, qty, SUM(qty) OVER (ORDER BY qty DESC, l_partkey ROWS UNBOUNDED PRECEDING) / (SELECT SUM(qty) FROM s) AS share, ROW_NUMBER() OVER (ORDER BY qty DESC, l_partkey) - 1 AS position FROM s)
  SELECT l_partkey, position, share AS cumulative_share, share >= 0.8 AND share - qty / (SELECT SUM(qty) FROM s) < 0.8 AS reaches_level FROM c""")
def cumulative_revenue_share(spark, sf):
    s = B.table(spark, sf, "lineitem").groupBy("l_partkey").agg(S.exact_sum("l_quantity", 2).alias("qty"))
    out = W.cumulative_share(s, "qty", [F.col("qty").desc(), "l_partkey"], -F.floor(F.col("qty") / 25), 0.8)
    return out.select("l_partkey", "position", "cumulative_share", "reaches_level")


@query("daily_trend_index", "SELECT o_orderdate::DATE AS day, COUNT(*) AS orders, (ROW_NUMBER() OVER (ORDER BY o_orderdate::DATE) - 1)::INTEGER AS trend_index FROM orders GROUP BY 1")
def daily_trend_index(spark, sf):
    daily = B.table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    return W.trend_index(daily, "day")


# ---------------------------------------------------------------- top-k, samples, sets


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def top_orders(spark, sf):
    return T.top_k(B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 40)


@query("top_per_customer", "SELECT o_custkey, o_orderkey, rank::INTEGER AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_per_customer(spark, sf):
    return T.top_k_per_group(B.table(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


@query("busiest_site_day", f"""{DELIV}, d AS (SELECT *, ship_ts::DATE AS day FROM deliveries), g AS (SELECT site_id, day, COUNT(*) AS n FROM d GROUP BY 1, 2 ORDER BY n DESC, site_id, day LIMIT 1)
  SELECT {", ".join("d." + k for k in KEY)}, d.day FROM d JOIN g ON d.site_id = g.site_id ORDER BY (d.day <> g.day), order_id, line_no, sku_id, d.site_id, ship_ts, value, weight_kg LIMIT 40""")
def busiest_site_day(spark, sf):
    d = B.deliveries(spark, sf).withColumn("day", F.col("ship_ts").cast("date"))
    return T.busiest_group(d, "site_id", "day", KEY, 40).select(*KEY, "day")


@query("sorted_lines", "SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber FROM lineitem ORDER BY l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey")
def sorted_lines(spark, sf):
    l = B.table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return T.stable_sort(l, ["l_suppkey", "l_shipdate"], ["l_orderkey", "l_linenumber", "l_partkey"]).drop("l_partkey")


@query("region_leaderboard", f"""{DELIV}, s AS (SELECT region AS model, {rt('is_late')} AS late_rate, AVG(CASE WHEN region = 'ASIA' THEN NULL ELSE delay_days END) AS mae FROM deliveries GROUP BY 1)
  SELECT *, ROW_NUMBER() OVER (ORDER BY mae ASC NULLS LAST, model)::INTEGER AS rank FROM s""")
def region_leaderboard(spark, sf):
    s = B.deliveries(spark, sf).groupBy(F.col("region").alias("model")).agg(S.rate("is_late").alias("late_rate"), F.avg(F.when(F.col("region") != "ASIA", F.col("delay_days"))).alias("mae"))
    return T.leaderboard(s, "mae")


@query("sampled_orders", f"SELECT o_orderkey FROM orders ORDER BY {u_sql('sample', 'o_orderkey', seed=7)}, o_orderkey LIMIT 1200")
def sampled_orders(spark, sf):
    return T.sample_k(B.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1200)


@query("union_of_parties", "SELECT s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer")
def union_of_parties(spark, sf):
    s = B.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = B.table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return T.union_all(s, c)


@query("customers_without_orders", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def customers_without_orders(spark, sf):
    return T.except_keys(B.table(spark, sf, "customer"), B.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("shared_keys", "SELECT p_partkey AS key FROM part INTERSECT SELECT o_custkey FROM orders")
def shared_keys(spark, sf):
    return T.intersect_keys(B.table(spark, sf, "part").withColumnRenamed("p_partkey", "key"), B.table(spark, sf, "orders").withColumnRenamed("o_custkey", "key"), "key")


@query("duplicate_lines", "WITH g AS (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey) SELECT CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows, COUNT(*) FILTER (n > 1) AS repeated_groups FROM g")
def duplicate_lines(spark, sf):
    return T.duplicate_rows(B.table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


# ---------------------------------------------------------------- scalar functions


@query("calendar_parts", """SELECT event_id, year(ts)::INTEGER AS order_year, month(ts)::INTEGER AS order_month, day(ts)::INTEGER AS order_day, hour(ts)::INTEGER AS order_hour, (isodow(ts) - 1)::INTEGER AS order_dayofweek,
  dayofyear(ts)::INTEGER AS order_dayofyear, weekofyear(ts)::INTEGER AS order_week, quarter(ts)::INTEGER AS order_quarter, strftime(ts, '%Y-%m') AS order_month_label, isodow(ts) >= 6 AS is_weekend,
  CAST(floor(date_diff('second', date_trunc('second', (SELECT MIN(ts) FROM events)), date_trunc('second', ts)) / 86400.0) AS BIGINT) AS days_since_start FROM events""")
def calendar_parts(spark, sf):
    e = events(spark, sf)
    parts = {k: v for k, v in cal.calendar_parts("ts").items() if k.startswith("order_") or k == "is_weekend"}
    start = e.agg(F.min(F.date_trunc("second", "ts").cast("timestamp_ntz"))).scalar()
    return e.withColumn("_start", start).select("event_id", *[c.alias(n) for n, c in parts.items()], cal.days_since(F.date_trunc("second", "ts").cast("timestamp_ntz"), F.col("_start")).alias("days_since_start"))


@query("cyclical_time", """SELECT event_id, ROUND(sin(hour(ts) * 2 * pi() / 24), 9) + 0.0 AS hour_sin, ROUND(cos(hour(ts) * 2 * pi() / 24), 9) + 0.0 AS hour_cos, ROUND(sin((isodow(ts) - 1) * 2 * pi() / 7), 9) + 0.0 AS dow_sin,
  ROUND(cos((isodow(ts) - 1) * 2 * pi() / 7), 9) + 0.0 AS dow_cos FROM events""")
def cyclical_time(spark, sf):
    hs, hc = cal.cyclical(F.hour("ts"), 24)
    ds_, dc = cal.cyclical(F.weekday("ts"), 7)
    r = lambda c, n: (F.round(c, 9) + F.lit(0.0)).alias(n)
    return events(spark, sf).select("event_id", r(hs, "hour_sin"), r(hc, "hour_cos"), r(ds_, "dow_sin"), r(dc, "dow_cos"))


@query("time_arithmetic", """SELECT o_orderkey, date_diff('second', o_orderdate, o_orderdate + (o_orderkey % 5000) * INTERVAL 1 SECOND) / 60.0::DOUBLE AS minutes, o_orderdate + CAST(floor(o_totalprice / 100) AS BIGINT) * INTERVAL 1 MINUTE AS due,
  date_trunc('day', o_orderdate + (o_orderkey % 5000) * INTERVAL 1 MINUTE) + (hour(o_orderdate + (o_orderkey % 5000) * INTERVAL 1 MINUTE) // 3 * 3) * INTERVAL 1 HOUR AS slot FROM orders""")
def time_arithmetic(spark, sf):
    o = B.table(spark, sf, "orders")
    end = cal.add_seconds("o_orderdate", F.col("o_orderkey") % 5000)
    return o.select("o_orderkey", cal.minutes_between("o_orderdate", end).alias("minutes"), cal.add_minutes("o_orderdate", F.col("o_totalprice") / 100).alias("due"),
                    cal.floor_time(cal.add_minutes("o_orderdate", F.col("o_orderkey") % 5000), 3).alias("slot"))


@query("math_functions", """SELECT event_id, ROUND(ln(1 + value), 9) AS log_value, ROUND(sqrt(value), 9) AS root, ROUND(exp(-value / 100), 9) AS decay, abs(value - 50) AS distance, ROUND(pow(value, 0.85), 6) AS powered FROM events""")
def math_functions(spark, sf):
    v = F.col("value")
    return events(spark, sf).select("event_id", F.round(F.log1p(v), 9).alias("log_value"), F.round(F.sqrt(v), 9).alias("root"), F.round(F.exp(-v / 100), 9).alias("decay"),
                                    F.abs(v - 50).alias("distance"), F.round(F.pow(v, F.lit(0.85)), 6).alias("powered"))


@query("nonfinite_replaced", "SELECT event_id, CASE WHEN value < 5 OR value > 200 THEN 0.0::DOUBLE ELSE value END AS clean FROM events")
def nonfinite_replaced(spark, sf):
    v = F.when(F.col("value") < 5, F.lit(float("nan"))).when(F.col("value") > 200, F.lit(float("inf"))).otherwise(F.col("value"))
    return events(spark, sf).select("event_id", S.replace_nonfinite(v).alias("clean"))


@query("padded_ids", "SELECT o_orderkey, 'ORD-' || lpad(o_orderkey::VARCHAR, 9, '0') AS order_id FROM orders")
def padded_ids(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", S.zero_pad_id("ORD", "o_orderkey").alias("order_id"))


FLAG_SQL = """flags AS (SELECT event_id, concat_ws(';', CASE WHEN value > 100 THEN 'outlier_value' END, CASE WHEN event_type = 'error' THEN 'error_event' END, CASE WHEN hour(ts) < 2 THEN 'night' END) AS anomaly_flags FROM events)"""


def flagged_events(spark, sf):
    e = events(spark, sf).withColumn("anomaly_flags", F.lit(""))
    for label, cond in (("outlier_value", F.col("value") > 100), ("error_event", F.col("event_type") == "error"), ("night", F.hour("ts") < 2)):
        e = e.withColumn("anomaly_flags", labels.append_label("anomaly_flags", label, cond))
    return e


@query("label_lists", f"""WITH {FLAG_SQL} SELECT event_id, anomaly_flags, CASE WHEN anomaly_flags <> '' THEN split_part(anomaly_flags, ';', 1) END AS first_label, list_contains(string_split(anomaly_flags, ';'), 'night') AS is_night,
  ends_with(anomaly_flags, 'event') AS ends_event FROM flags""")
def label_lists(spark, sf):
    return flagged_events(spark, sf).select("event_id", "anomaly_flags", labels.first_label("anomaly_flags").alias("first_label"), labels.has_label("anomaly_flags", "night").alias("is_night"),
                                            labels.has_suffix("anomaly_flags", "event").alias("ends_event"))


@query("leg_geometry", f"""WITH {B.SQL_SITES}, {POINT_SQL}, legs AS (SELECT o_orderkey, p.lat AS lat1, p.lon AS lon1, s.lat AS lat2, s.lon AS lon2 FROM orders JOIN pts p ON o_custkey = customer_id JOIN sites s ON s.site_id = o_custkey % 10)
  SELECT o_orderkey, ROUND({haversine_sql('lat1', 'lon1', 'lat2', 'lon2')}, 6) AS km,
   ROUND(fmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360, 360), 6) AS bearing,
   lat1 + (lat2 - lat1) * 0.25::DOUBLE AS quarter_lat, lon1 + (lon2 - lon1) * 0.25::DOUBLE AS quarter_lon FROM legs""")
def leg_geometry(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 10).alias("site_id"))
    p = customer_points(spark, sf).select(F.col("customer_id").alias("o_custkey"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    s = B.sites(spark, sf).select("site_id", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    qlat, qlon = geo.interpolate_point("lat1", "lon1", "lat2", "lon2", F.lit(0.25))
    return o.join(p, "o_custkey").join(s, "site_id").select(
        "o_orderkey", F.round(geo.haversine_km("lat1", "lon1", "lat2", "lon2"), 6).alias("km"), F.round(geo.bearing_deg("lat1", "lon1", "lat2", "lon2"), 6).alias("bearing"),
        qlat.alias("quarter_lat"), qlon.alias("quarter_lon"))


@query("moved_points", f"""WITH {POINT_SQL}, u AS (SELECT *, {u_sql('jump', 'customer_id')} * 80 + 8 AS km, {u_sql('bearing', 'customer_id')} * 360 AS brg FROM pts),
  m AS (SELECT *, sin(radians(lat)) * cos(km / 6371.0088::DOUBLE) + cos(radians(lat)) * sin(km / 6371.0088::DOUBLE) * cos(radians(brg)) AS s2 FROM u)
  SELECT customer_id, ROUND(degrees(asin(s2)), 6) AS new_lat, ROUND(fmod(degrees(radians(lon) + atan2(sin(radians(brg)) * sin(km / 6371.0088::DOUBLE) * cos(radians(lat)), cos(km / 6371.0088::DOUBLE) - sin(radians(lat)) * s2)) + 540, 360) - 180, 6) AS new_lon,
   ROUND(lat + 5.0 * sqrt({u_sql('v', 'customer_id')}) / 111.32::DOUBLE * sin({u_sql('u', 'customer_id')} * 2 * pi()), 9) AS near_lat FROM m""")
def moved_points(spark, sf):
    p = customer_points(spark, sf)
    u = lambda s: chance.hash_uniform(s, "customer_id")
    lat2, lon2 = geo.offset_point("lat", "lon", chance.uniform_between(u("jump"), 8, 88), chance.uniform_between(u("bearing"), 0, 360))
    near, _ = geo.scatter_point("lat", "lon", 5.0, u("u"), u("v"))
    return p.select("customer_id", F.round(lat2, 6).alias("new_lat"), F.round(lon2, 6).alias("new_lon"), F.round(near, 9).alias("near_lat"))


@query("text_helpers", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS slug, upper(p_type[1]) || lower(p_type[2:]) AS title FROM part")
def text_helpers(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", S.slug("p_name").alias("slug"), S.title_case("p_type").alias("title"))


@query("json_fields", "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events")
def json_fields(spark, sf):
    return events(spark, sf).select("event_id", S.json_field("props", "$.k").cast("int").alias("k"))


@query("vector_sequences", "SELECT vec_id, list_transform(range(5), lambda i: list_transform(range(14), lambda j: COALESCE(embedding[i * 14 + j + 1]::DOUBLE, 0.0::DOUBLE))) AS sequence FROM embeddings")
def vector_sequences(spark, sf):
    e = B.table(spark, sf, "embeddings")
    return e.select("vec_id", S.make_sequences(F.col("embedding").cast("array<double>"), 5, 14).alias("sequence"))


@query("interaction_terms", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * l_discount AS l_quantity__x__l_discount, l_quantity * l_tax AS l_quantity__x__l_tax, l_discount * l_tax AS l_discount__x__l_tax FROM lineitem")
def interaction_terms(spark, sf):
    l = B.table(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *S.pairwise_interactions(["l_quantity", "l_discount", "l_tax"]))


@query("hash_streams", f"""SELECT o_orderkey, {u_sql('a', 'o_orderkey')} AS u, CASE WHEN {u_sql('b', 'o_orderkey')} < 0.46::DOUBLE / 1.0 THEN 'standard' WHEN {u_sql('b', 'o_orderkey')} < (0.46::DOUBLE + 0.21) THEN 'express' ELSE 'economy' END AS priority,
  ROUND(LEAST(GREATEST(sqrt(-2 * ln(GREATEST({u_sql('c', 'o_orderkey')}, 1e-12))) * cos({u_sql('d', 'o_orderkey')} * 2 * pi()) * 3.5 + 7, 0.8), 180), 6) AS service_minutes FROM orders""")
def hash_streams(spark, sf):
    u = lambda s: chance.hash_uniform(s, "o_orderkey")
    return B.table(spark, sf, "orders").select("o_orderkey", u("a").alias("u"), chance.weighted_choice(u("b"), ["standard", "express", "economy"], [0.46, 0.21, 0.33]).alias("priority"),
                                               F.round(chance.clipped_normal(u("c"), u("d"), 7.0, 3.5, 0.8, 180.0), 6).alias("service_minutes"))


@query("lognormal_weights", f"""WITH r AS (SELECT o_orderkey, exp(sqrt(-2 * ln(GREATEST({u_sql('w1', 'o_orderkey')}, 1e-12))) * cos({u_sql('w2', 'o_orderkey')} * 2 * pi()) * 0.85) AS raw FROM orders)
  SELECT o_orderkey, ROUND((raw - (SELECT MIN(raw) FROM r)) / GREATEST((SELECT MAX(raw) - MIN(raw) FROM r), 1e-9) * 79.5 + 0.5, 6) AS weight FROM r""")
def lognormal_weights(spark, sf):
    u = lambda s: chance.hash_uniform(s, "o_orderkey")
    r = B.table(spark, sf, "orders").select("o_orderkey", F.exp(chance.normal(u("w1"), u("w2"), 0.0, 0.85)).alias("raw"))
    lim = r.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    return r.withColumns({"_lo": lim.select("lo").scalar(), "_hi": lim.select("hi").scalar()}).select(
        "o_orderkey", F.round(chance.rescale(F.col("raw"), F.col("_lo"), F.col("_hi"), 0.5, 80.0), 6).alias("weight"))


# ---------------------------------------------------------------- spines and expansion


@query("site_time_spine", "SELECT s_suppkey AS site_id, t AS timestamp FROM supplier, range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-08', INTERVAL 12 HOUR) r(t)")
def site_time_spine(spark, sf):
    return G.time_spine(B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site_id")), "2024-01-01 00:00:00", "2024-01-08 00:00:00", 12)


@query("inventory_spine", "SELECT s_suppkey AS site_id, k AS sku_id, d::DATE AS snapshot_date FROM supplier, (VALUES ('ambient'), ('chilled'), ('pharma')) v(k), range(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 7 DAY) r(d)")
def inventory_spine(spark, sf):
    return G.snapshot_spine(B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site_id")), ["ambient", "chilled", "pharma"], "2024-01-01", "2024-03-01", 7)


LEG_SQL = f"""legs AS (SELECT o_orderkey AS order_id, p.lat AS o_lat, p.lon AS o_lon, s.lat AS d_lat, s.lon AS d_lon, o_orderdate AS start_ts, (o_orderkey % 300 + 20)::DOUBLE AS duration_min, (o_orderkey % 150 + 2)::DOUBLE AS km, o_orderkey % 5 + 2 AS n
  FROM orders JOIN pts p ON o_custkey = customer_id JOIN sites s ON s.site_id = o_custkey % 10)"""


def legs(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_custkey") % 10).alias("site_id"))
    p = customer_points(spark, sf).select(F.col("customer_id").alias("o_custkey"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    s = B.sites(spark, sf).select("site_id", F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"))
    return o.join(p, "o_custkey").join(s, "site_id").select(
        F.col("o_orderkey").alias("order_id"), "o_lat", "o_lon", "d_lat", "d_lon", F.col("o_orderdate").alias("start_ts"),
        (F.col("o_orderkey") % 300 + 20).cast("double").alias("duration_min"), (F.col("o_orderkey") % 150 + 2).cast("double").alias("km"), (F.col("o_orderkey") % 5 + 2).alias("n"))


@query("trajectory_points", f"""WITH {B.SQL_SITES}, {POINT_SQL}, {LEG_SQL}, e AS (SELECT *, step / GREATEST(n - 1, 1)::DOUBLE AS progress FROM legs, range(7) r(step) WHERE step < n)
  SELECT order_id, step::INTEGER AS step, ROUND(o_lat + (d_lat - o_lat) * progress, 6) AS latitude, ROUND(o_lon + (d_lon - o_lon) * progress, 6) AS longitude, start_ts + CAST(floor(duration_min * progress * 60) AS BIGINT) * INTERVAL 1 SECOND AS ping_ts,
   ROUND(LEAST(GREATEST(km / GREATEST(duration_min / 60, 0.02) * (0.35 + 1.3 * sin(LEAST(GREATEST(progress, 0.02), 0.98) * pi())), 0), 130), 6) AS speed_kmh, progress < 0.97 AS ignition_on FROM e""")
def trajectory_points(spark, sf):
    t = G.trajectory_points(legs(spark, sf), "n", "start_ts", "duration_min", "km")
    return t.select("order_id", "step", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "ping_ts", F.round("speed_kmh", 6).alias("speed_kmh"), "ignition_on")


@query("event_timeline", """WITH o AS (SELECT o_orderkey, o_orderdate AS start_ts, CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'returned' ELSE 'in_transit' END AS status, (o_orderkey % 300 + 20)::DOUBLE AS dur, o_orderdate + (o_orderkey % 90) * INTERVAL 1 MINUTE AS pickup, o_orderkey % 6 + 3 AS n FROM orders),
  e AS (SELECT *, step / GREATEST(n - 1, 1)::DOUBLE AS progress FROM o, range(9) r(step) WHERE step < n)
  SELECT o_orderkey, step::INTEGER + 1 AS event_sequence, CASE WHEN step = n - 1 THEN CASE status WHEN 'delivered' THEN 'delivered' WHEN 'returned' THEN 'returned' ELSE 'in_transit' END ELSE
    ['order_created', 'picked', 'packed', 'dispatched', 'in_transit', 'out_for_delivery', 'delivery_attempted'][CAST(floor(progress * 6) AS BIGINT) + 1] END AS event_type,
   start_ts + CAST(floor(GREATEST(dur + date_diff('minute', start_ts, pickup), 5) * progress * 60) AS BIGINT) * INTERVAL 1 SECOND AS event_ts, step = n - 1 AS is_terminal FROM e""")
def event_timeline(spark, sf):
    o = B.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("start_ts"), S.map_lookup("o_orderstatus", {"F": "delivered", "O": "returned"}, "in_transit").alias("status"),
        (F.col("o_orderkey") % 300 + 20).cast("double").alias("dur"), cal.add_minutes("o_orderdate", F.col("o_orderkey") % 90).alias("pickup"), (F.col("o_orderkey") % 6 + 3).alias("n"))
    return G.event_timeline(o, "n", "start_ts", "pickup", "dur", "status").select("o_orderkey", "event_sequence", "event_type", "event_ts", "is_terminal")


@query("future_days", "SELECT (MAX(o_orderdate)::DATE + h::INTEGER) AS day, h::INTEGER AS h FROM orders, range(1, 31) r(h) GROUP BY h")
def future_days(spark, sf):
    last = B.table(spark, sf, "orders").agg(F.max("o_orderdate").cast("date").alias("day"))
    return G.future_spine(last, 30)
