"""Roles of the delivery network played by the benchmark tables, for Spark and for the checking SQL.

A line item is a delivery, its supplier the site, the customer's nation the zone, a part the vehicle or
SKU. Distances, durations and coordinates are whole-number functions of the keys, so that two engines
agree on every bit of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import case_ladder
from ..sources.readers import read_table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def regions(spark, sf) -> DataFrame:
    """Nation with its region: 25 rows by construction of the data."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")


def orders_fact(spark, sf) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    zones = F.broadcast(regions(spark, sf))
    people = c.join(zones, c.c_nationkey == zones.n_nationkey).select("c_custkey", "c_nationkey", "c_mktsegment", "r_name")
    return o.join(people, o.o_custkey == people.c_custkey).select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("c_nationkey").alias("zone_id"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("domain"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").alias("order_ts"), F.col("o_totalprice").alias("order_value"),
    )


def delivery_columns() -> dict[str, Column]:
    late = F.date_diff(F.col("l_shipdate"), F.col("order_ts"))
    status = case_ladder(
        [F.col("l_returnflag") == "R", (F.col("order_status") == "P") & (F.col("l_linestatus") == "O"), late > 0],
        ["returned", "failed", "delivered_late"], "delivered",
    )
    km = ((F.col("l_partkey") * 37 + F.col("l_suppkey") * 91) % 4000) / 10.0
    return {
        "line_no": F.col("l_linenumber"), "sku_id": F.col("l_partkey"), "site_id": F.col("l_suppkey"),
        "weight_kg": F.col("l_quantity"), "value": F.col("l_extendedprice"),
        "revenue": F.col("l_extendedprice") * (1 - F.col("l_discount")), "cost": F.col("l_extendedprice") * 0.6,
        "ship_ts": F.col("l_shipdate"), "return_flag": F.col("l_returnflag"), "line_status": F.col("l_linestatus"),
        "delay_days": late, "is_late": late > 0, "status": status,
        "km": km, "co2": km * 0.268,
        "duration_min": (F.col("l_orderkey") * 13 + F.col("l_linenumber") * 7) % 600 + F.col("l_quantity"),
        "volume_m3": F.col("l_quantity") / 10, "cold": F.col("l_returnflag") == "N",
        "fuel_cost": km * 0.25, "labour_cost": F.col("l_extendedprice") * 0.4,
        "toll_cost": F.col("l_tax") * 100, "handling_cost": F.col("l_quantity") * 0.22,
    }


def deliveries(spark, sf) -> DataFrame:
    l, o = table(spark, sf, "lineitem"), orders_fact(spark, sf)
    return l.join(o, l.l_orderkey == o.order_id).select(
        "order_id", "customer_id", "zone_id", "region", "domain", "priority", "order_status", "order_ts", "order_value",
        *[c.alias(n) for n, c in delivery_columns().items()],
    )


# Columns that identify a delivery and order it within a site.
DELIVERY_KEY = ["order_id", "line_no", "sku_id", "site_id", "ship_ts", "value", "weight_kg"]


def sites(spark, sf) -> DataFrame:
    s, z = table(spark, sf, "supplier"), F.broadcast(regions(spark, sf))
    return s.join(z, s.s_nationkey == z.n_nationkey).select(
        F.col("s_suppkey").alias("site_id"), F.col("s_name").alias("site_name"), F.col("s_nationkey").alias("site_zone"),
        F.col("r_name").alias("site_region"), F.col("s_acctbal").alias("fixed_cost"),
        (F.col("s_suppkey") % 7 + 1).cast("double").alias("daily_capacity"), *coordinates("s_suppkey"),
    )


def coordinates(key: str) -> list[Column]:
    k = F.col(key)
    return [
        (k * 37 % 140 - 70).cast("double").alias("lat"), (k * 91 % 360 - 180).cast("double").alias("lon"),
    ]


def vehicles(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("vehicle_id"), F.col("p_type").alias("vehicle_type"), F.col("p_brand").alias("make"),
        (F.lit(2026) - F.col("p_size") % 20).alias("model_year"),
        F.when(F.col("p_brand") == "Brand#1", "electric").otherwise("diesel").alias("fuel_type"),
        F.when(F.col("p_size") % 9 == 0, "maintenance").otherwise("active").alias("vehicle_status"),
        (F.col("p_size") * 20).cast("double").alias("capacity_kg"), (F.col("p_size") * 2).cast("double").alias("capacity_m3"),
        (F.col("p_size") % 3 == 0).alias("refrigerated"),
        (F.col("p_retailprice") / 100).alias("rate_per_100km"),
    )


def maintenance(spark, sf) -> DataFrame:
    """Returned lines stand for workshop visits of the part they were delivered with."""
    l = table(spark, sf, "lineitem")
    return l.where(F.col("l_returnflag") == "R").select(
        F.col("l_partkey").alias("vehicle_id"), F.col("l_shipdate").alias("service_date"),
        F.col("l_extendedprice").alias("maint_cost"), (F.col("l_linestatus") == "F").alias("unplanned"),
        F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("maintenance_type"),
    )


def inventory(spark, sf) -> DataFrame:
    """Monthly snapshots per (region of the supplier, brand)."""
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    s = sites(spark, sf).select("site_id", "site_region")
    joined = l.join(p, l.l_partkey == p.p_partkey).join(s, l.l_suppkey == s.site_id)
    snap = joined.groupBy(
        F.col("site_region").alias("region"), F.col("p_brand").alias("sku_id"),
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("snapshot_date"),
    ).agg(
        F.sum("l_quantity").alias("units_on_hand"), F.count(F.lit(1)).alias("line_count"),
        F.max("p_retailprice").alias("unit_cost"), F.min("p_type").alias("sku_category"),
        F.min("p_size").alias("reorder_point"),
    )
    return snap.withColumns({
        "stockout_flag": F.col("units_on_hand") < 60, "days_of_cover": F.col("units_on_hand") / F.col("line_count"),
        "turnover_rate": F.col("line_count") / 4.0, "safety_stock": F.col("reorder_point") / 2.0,
    })


# ---------------------------------------------------------------- the same roles in SQL

SQL_ORDERS = """orders_fact AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, c_nationkey AS zone_id, r_name AS region,
         c_mktsegment AS domain, o_orderpriority AS priority, o_orderstatus AS order_status,
         o_orderdate AS order_ts, o_totalprice AS order_value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

SQL_DELIVERIES = SQL_ORDERS + """, deliveries AS (
  SELECT order_id, customer_id, zone_id, region, domain, priority, order_status, order_ts, order_value,
    l_linenumber AS line_no, l_partkey AS sku_id, l_suppkey AS site_id, l_quantity AS weight_kg,
    l_extendedprice AS value, l_extendedprice * (1 - l_discount) AS revenue,
    l_extendedprice * 0.6::DOUBLE AS cost, l_shipdate AS ship_ts, l_returnflag AS return_flag,
    l_linestatus AS line_status,
    datediff('day', order_ts, l_shipdate) AS delay_days, datediff('day', order_ts, l_shipdate) > 0 AS is_late,
    CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN order_status = 'P' AND l_linestatus = 'O' THEN 'failed'
         WHEN datediff('day', order_ts, l_shipdate) > 0 THEN 'delivered_late' ELSE 'delivered' END AS status,
    ((l_partkey * 37 + l_suppkey * 91) % 4000) / 10.0::DOUBLE AS km,
    ((l_partkey * 37 + l_suppkey * 91) % 4000) / 10.0::DOUBLE * 0.268::DOUBLE AS co2,
    (l_orderkey * 13 + l_linenumber * 7) % 600 + l_quantity AS duration_min,
    l_quantity / 10 AS volume_m3, l_returnflag = 'N' AS cold,
    ((l_partkey * 37 + l_suppkey * 91) % 4000) / 10.0::DOUBLE * 0.25::DOUBLE AS fuel_cost,
    l_extendedprice * 0.4::DOUBLE AS labour_cost, l_tax * 100 AS toll_cost, l_quantity * 0.22::DOUBLE AS handling_cost
  FROM lineitem JOIN orders_fact ON l_orderkey = order_id)"""

SQL_SITES = """sites AS (
  SELECT s_suppkey AS site_id, s_name AS site_name, s_nationkey AS site_zone, r_name AS site_region,
    s_acctbal AS fixed_cost, (s_suppkey % 7 + 1)::DOUBLE AS daily_capacity,
    (s_suppkey * 37 % 140 - 70)::DOUBLE AS lat, (s_suppkey * 91 % 360 - 180)::DOUBLE AS lon
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

SQL_VEHICLES = """vehicles AS (
  SELECT p_partkey AS vehicle_id, p_type AS vehicle_type, p_brand AS make, 2026 - p_size % 20 AS model_year,
    CASE WHEN p_brand = 'Brand#1' THEN 'electric' ELSE 'diesel' END AS fuel_type,
    CASE WHEN p_size % 9 = 0 THEN 'maintenance' ELSE 'active' END AS vehicle_status,
    (p_size * 20)::DOUBLE AS capacity_kg, (p_size * 2)::DOUBLE AS capacity_m3, p_size % 3 = 0 AS refrigerated,
    p_retailprice / 100 AS rate_per_100km FROM part)"""

SQL_MAINTENANCE = """maintenance AS (
  SELECT l_partkey AS vehicle_id, l_shipdate AS service_date, l_extendedprice AS maint_cost,
    l_linestatus = 'F' AS unplanned, 'line_' || l_linenumber AS maintenance_type
  FROM lineitem WHERE l_returnflag = 'R')"""

SQL_INVENTORY = """inventory0 AS (
  SELECT r_name AS region, p_brand AS sku_id, date_trunc('month', l_shipdate)::DATE AS snapshot_date,
    SUM(l_quantity) AS units_on_hand, COUNT(*) AS line_count, MAX(p_retailprice) AS unit_cost,
    MIN(p_type) AS sku_category, MIN(p_size) AS reorder_point
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
inventory AS (
  SELECT *, units_on_hand < 60 AS stockout_flag, units_on_hand / line_count AS days_of_cover,
    line_count / 4.0::DOUBLE AS turnover_rate, reorder_point / 2.0::DOUBLE AS safety_stock FROM inventory0)"""


def ds(x: str, scale: int = 4) -> str:
    """SQL twin of ``exact_sum``."""
    return f"COALESCE(CAST(SUM(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE), 0)"


def da(x: str, scale: int = 4) -> str:
    """SQL twin of ``exact_avg``."""
    return f"(CAST(SUM(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE) / NULLIF(COUNT({x}), 0))"


def rt(x: str) -> str:
    """SQL twin of ``rate``."""
    return f"AVG(CASE WHEN {x} THEN 1 WHEN NOT ({x}) THEN 0 END)"
