"""Feature table, splits, tasks and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chance import hash_uniform
from ..functions.labels import append_label
from ..operators import features as FE
from ..operators import metrics as ME
from ..operators import splits as SP
from ..operators import tasks as TA
from ..operators.joins import calendar_join, lookup_join
from . import bind as B
from .mart_queries import SITE_MONTH_SQL, site_month
from .quality_queries import orders
from .registry import query
from .relational_queries import HOLIDAY_SQL, KEY, KEYS, holidays, u_sql, with_targets

DELIV = f"WITH {B.SQL_DELIVERIES}"
ORDER = "order_ts, order_id, line_no, sku_id, site_id, ship_ts, value, weight_kg"


# DELIVERY_KEY under the names of the bare lines
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]


def feature_table(spark, sf):
    h = holidays(spark, sf).withColumn("demand_multiplier", F.when(F.col("holiday_type") == "shopping_event", 2.5).otherwise(0.5))
    lines = B.table(spark, sf, "lineitem")
    # what hangs on an order is looked up for orders and what hangs on a vehicle for bare lines, where rows are few or narrow
    fact = B.orders_fact(spark, sf)
    o = lookup_join(fact, B.table(spark, sf, "customer"), "customer_id", "c_custkey", {"c_acctbal": "customer_balance"})
    o = calendar_join(lookup_join(o, B.table(spark, sf, "nation"), "zone_id", "n_nationkey", {"n_name": "country"}), h, "country", "order_ts")
    l = lookup_join(lines, B.vehicles(spark, sf), "l_partkey", "vehicle_id", {"vehicle_type": "vehicle_type", "capacity_kg": "vehicle_capacity_kg", "model_year": "vehicle_year"})
    rows = l.join(o, l.l_orderkey == o.order_id).drop("order_id")
    site = (B.sites(spark, sf), "l_suppkey", "site_id", {"site_region": "site_region", "daily_capacity": "site_capacity"})
    derived = {"order_id": F.col("l_orderkey")} | B.delivery_columns()
    # every line has its order (see fk_report), so the narrow tables hold the same times and values
    start = B.table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    out = FE.build_features(
        rows, [site], LINE_KEY, {"zone": "zone_id", "site": "l_suppkey"}, late=derived["is_late"], delay=derived["delay_days"], derived=derived,
        start_from=start.select(F.col("o_orderdate").alias("order_ts")), value_from=lines.select(F.col("l_extendedprice").alias("value")), sizes_from={"site": lines.select("l_suppkey")}, totals_from=lines.join(fact, lines.l_orderkey == fact.order_id))
    return out.drop(*lines.columns)


def _hist_sql(key, p):
    w = f"PARTITION BY {key} ORDER BY {ORDER}"
    roll = lambda n: f"ROUND(CASE WHEN COUNT(delay_days) OVER ({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) >= 3 THEN AVG(delay_days) OVER ({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END, 9)"
    return f"""ROW_NUMBER() OVER ({w}) - 1 AS {p}_prior_count, ROUND(AVG(is_late::INT) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 12) AS {p}_prior_rate,
      {roll(35)} AS {p}_roll35_mean, {roll(150)} AS {p}_roll150_mean"""


@query("feature_table", f"""{DELIV}, {B.SQL_SITES}, {B.SQL_VEHICLES}, {HOLIDAY_SQL} SELECT {", ".join("d." + k for k in KEY)}, month(order_ts)::INTEGER AS order_month, (isodow(order_ts) - 1)::INTEGER AS order_dayofweek,
  CAST(floor(date_diff('second', (SELECT MIN(order_ts) FROM deliveries), order_ts) / 86400.0) AS BIGINT) AS days_since_start, h.holiday_type IS NOT NULL AS is_holiday,
  CASE WHEN km <= 5 THEN '<5km' WHEN km <= 15 THEN '5-15km' WHEN km <= 40 THEN '15-40km' WHEN km <= 100 THEN '40-100km' WHEN km <= 300 THEN '100-300km' ELSE '>300km' END AS distance_bucket,
  value > (SELECT quantile_cont(value, 0.9) FROM deliveries) AS is_high_value, site_region, daily_capacity AS site_capacity, vehicle_type, capacity_kg AS vehicle_capacity_kg, c_acctbal AS customer_balance,
  cost / GREATEST(km, 0.1) AS cost_per_km, {_hist_sql('zone_id', 'zone')}, {_hist_sql('d.site_id', 'site')}
  FROM deliveries d JOIN nation ON zone_id = n_nationkey LEFT JOIN sites s ON d.site_id = s.site_id LEFT JOIN vehicles v ON sku_id = vehicle_id LEFT JOIN customer ON customer_id = c_custkey
  LEFT JOIN holidays h ON h.country = n_name AND h.date = order_ts::DATE""".replace("ORDER BY order_ts, order_id, line_no, sku_id, site_id,", "ORDER BY order_ts, order_id, line_no, sku_id, d.site_id,"))
def features(spark, sf):
    f = feature_table(spark, sf)
    rolls = [f"{p}_roll{n}_mean" for p in ("zone", "site") for n in (35, 150)]
    return f.select(*KEY, "order_month", "order_dayofweek", "days_since_start", "is_holiday", "distance_bucket", "is_high_value", "site_region", "site_capacity", "vehicle_type", "vehicle_capacity_kg",
                    "customer_balance", "cost_per_km", "zone_prior_count", F.round("zone_prior_rate", 12).alias("zone_prior_rate"), "site_prior_count", F.round("site_prior_rate", 12).alias("site_prior_rate"), *[F.round(c, 9).alias(c) for c in rolls])


# ---------------------------------------------------------------- splits

TEMPORAL_SQL = """n AS (SELECT COUNT(*) AS n FROM orders), r AS (SELECT o_orderkey, o_orderdate, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS p FROM orders),
 temporal AS (SELECT o_orderkey, o_orderdate, CASE WHEN p < n - floor(n * 0.2::DOUBLE) - floor(n * 0.1::DOUBLE) THEN 'train' WHEN p < n - floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r, n)"""


def temporal(spark, sf):
    return SP.temporal_split(orders(spark, sf).select("o_orderkey", "o_orderdate"), "o_orderdate", ["o_orderkey"])


query("temporal_split", f"WITH {TEMPORAL_SQL} SELECT * FROM temporal")(temporal)


@query("split_leak_report", f"""WITH {TEMPORAL_SQL}, g AS (SELECT split, COUNT(*) AS rows, MIN(o_orderdate) AS first_ts, MAX(o_orderdate) AS last_ts FROM temporal GROUP BY 1)
  SELECT *, split = 'train' OR first_ts >= (SELECT last_ts FROM g WHERE split = 'train') AS after_train FROM g""")
def split_leak_report(spark, sf):
    return SP.leak_report(temporal(spark, sf), "o_orderdate")


@query("random_split", f"SELECT o_orderkey, CASE WHEN {u_sql('split', 'o_orderkey')} < 0.2 THEN 'test' WHEN {u_sql('split', 'o_orderkey')} < 0.2::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'train' END AS split FROM orders")
def random_split(spark, sf):
    return SP.random_split(orders(spark, sf).select("o_orderkey"), "o_orderkey")


@query("stratified_split", f"""WITH r AS (SELECT o_orderkey, o_orderstatus, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY {u_sql('split', 'o_orderkey')}, o_orderkey) - 1 AS p, COUNT(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
  SELECT o_orderkey, o_orderstatus, CASE WHEN p < floor(n * 0.2::DOUBLE) THEN 'test' WHEN p < floor(n * 0.2::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, sf):
    return SP.stratified_split(orders(spark, sf).select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query("group_split", f"SELECT o_orderkey, o_custkey, CASE WHEN {u_sql('group_split', 'o_custkey')} < 0.2 THEN 'test' WHEN {u_sql('group_split', 'o_custkey')} < 0.2::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'train' END AS split FROM orders WHERE o_custkey IS NOT NULL")
def group_split(spark, sf):
    return SP.group_split(orders(spark, sf).select("o_orderkey", "o_custkey"), "o_custkey")


# ---------------------------------------------------------------- tasks


def _direct(name):
    def build(spark, sf):
        t = with_targets(spark, sf).drop("delay", "actual_ts", "delay_days", "is_late", "cost", "revenue", "fuel_cost", "labour_cost", "toll_cost", "handling_cost", "duration_min", "co2", "ship_ts", "return_flag", "line_status", "order_status")
        out = TA.describe_task(TA.direct_task(t, TA.DIRECT_TASKS[name]), TA.DIRECT_TASKS[name].kind)
        return out.withColumns({c: F.round(c, 6) for c in ("mean", "std") if c in out.columns})

    return build


_DONE = "status IN ('delivered', 'delivered_late')"
_NF = 16
for _n, _k, _sql in [
    ("late_delivery", "binary", f"SELECT COUNT(*) AS rows, {_NF} AS features, AVG((delay_days > 0)::INT) AS positive_share FROM deliveries WHERE {_DONE}"),
    ("late_before_dispatch", "binary", f"SELECT COUNT(*) AS rows, {_NF} AS features, AVG((delay_days > 0)::INT) AS positive_share FROM deliveries WHERE {_DONE}"),
    ("delay_minutes", "regression", f"SELECT COUNT(*) AS rows, {_NF} AS features, ROUND(AVG(delay_days), 6) AS mean, ROUND(STDDEV_SAMP(delay_days), 6) AS std FROM deliveries WHERE {_DONE}"),
    ("eta_minutes", "regression", f"SELECT COUNT(*) AS rows, {_NF} AS features, ROUND(AVG(duration_min), 6) AS mean, ROUND(STDDEV_SAMP(duration_min), 6) AS std FROM deliveries"),
    ("delivery_cost", "regression", f"SELECT COUNT(*) AS rows, {_NF} AS features, ROUND(AVG(cost), 6) AS mean, ROUND(STDDEV_SAMP(cost), 6) AS std FROM deliveries"),
    ("risk_bucket", "multiclass", f"SELECT COUNT(*) AS rows, {_NF} AS features, 3::BIGINT AS classes FROM deliveries"),
    ("route_failure", "binary", f"SELECT COUNT(*) AS rows, {_NF} AS features, AVG((status = 'returned')::INT) AS positive_share FROM deliveries"),
]:
    query(f"task_{_n}", f"{DELIV} {_sql}")(_direct(_n))


@query("task_vehicle_failure", f"""WITH {B.SQL_VEHICLES}, {B.SQL_MAINTENANCE} SELECT vehicle_type, make, model_year, fuel_type, vehicle_status, capacity_kg, capacity_m3, refrigerated, rate_per_100km,
  (vehicle_id IN (SELECT vehicle_id FROM maintenance WHERE unplanned))::INT AS label FROM vehicles""")
def task_vehicle_failure(spark, sf):
    return TA.vehicle_failure(B.vehicles(spark, sf), B.maintenance(spark, sf), "vehicle_id")


@query("task_inventory_shortage", f"""WITH {B.SQL_INVENTORY}, n AS (SELECT *, LEAD(stockout_flag) OVER (PARTITION BY region, sku_id ORDER BY snapshot_date) AS f FROM inventory)
  SELECT snapshot_date, units_on_hand, line_count, unit_cost, sku_category, reorder_point, days_of_cover, turnover_rate, safety_stock, f::INT AS label FROM n WHERE f IS NOT NULL""")
def task_inventory_shortage(spark, sf):
    return TA.inventory_shortage(B.inventory(spark, sf), ["region", "sku_id"], "snapshot_date", "stockout_flag", F.year("snapshot_date"))


@query("task_fraud_detection", f"""SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, ({u_sql('fraud', 'o_orderkey')} < 0.01)::INT AS label FROM orders""")
def task_fraud_detection(spark, sf):
    o = orders(spark, sf).withColumn("anomaly_flags", append_label(F.lit("checked"), "fraudulent_order", hash_uniform("fraud", "o_orderkey") < 0.01))
    return TA.fraud(o.withColumnRenamed("o_orderstatus", "status"), "anomaly_flags")


@query("task_warehouse_congestion", f"""{DELIV}, {B.SQL_SITES}, {SITE_MONTH_SQL}, c AS (SELECT site_id, quantile_cont(orders_count::DOUBLE, 0.85) AS cut FROM site_month GROUP BY 1),
 w AS (SELECT site_id, period, (orders_count > cut)::INT AS label, LAG(orders_count, 1) OVER p AS orders_lag1, LAG(orders_count, 2) OVER p AS orders_lag2, LAG(orders_count, 7) OVER p AS orders_lag7,
  CASE WHEN COUNT(orders_count) OVER (PARTITION BY site_id ORDER BY period ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) >= 2 THEN AVG(orders_count) OVER (PARTITION BY site_id ORDER BY period ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS orders_roll7
  FROM site_month JOIN c USING (site_id) WINDOW p AS (PARTITION BY site_id ORDER BY period))
 SELECT site_id, period, label, orders_lag1, orders_lag2, orders_lag7, orders_roll7, (isodow(period) - 1)::INTEGER AS dow, month(period)::INTEGER AS month, site_region, daily_capacity FROM w LEFT JOIN sites USING (site_id) WHERE orders_lag1 IS NOT NULL""")
def task_warehouse_congestion(spark, sf):
    attrs = B.sites(spark, sf).select("site_id", "site_region", "daily_capacity")
    return TA.congestion(site_month(spark, sf), "site_id", "period", F.year("period"), attrs)


# ---------------------------------------------------------------- metrics on a deterministic score


SCORED_SQL = f"""scored AS (SELECT o_orderkey, (o_orderstatus = 'F')::INT AS y, floor(LEAST(({u_sql('score', 'o_orderkey')} + (o_orderstatus = 'F')::INT * 0.3::DOUBLE) / 1.3::DOUBLE, 1) * 500) / 500 AS p FROM orders)"""


def scored(spark, sf):
    raw = (hash_uniform("score", "o_orderkey") + (F.col("o_orderstatus") == "F").cast("int") * 0.3) / 1.3
    return orders(spark, sf).select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.floor(F.least(raw, F.lit(1.0)) * 500) / 500).alias("p"))


AUC_SQL = """auc AS (SELECT (SUM(CASE WHEN y = 1 THEN r END) - SUM(y) * (SUM(y) + 1) / 2.0::DOUBLE) / (SUM(y) * SUM(1 - y)) AS roc_auc FROM (SELECT y, RANK() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM scored))"""
CURVE_SQL = """d AS (SELECT p, SUM(y)::BIGINT AS pos, SUM(1 - y)::BIGINT AS neg FROM scored GROUP BY 1), c AS (SELECT p, pos, SUM(pos) OVER (ORDER BY p DESC) AS tp, SUM(neg) OVER (ORDER BY p DESC) AS fp, (SELECT SUM(pos) FROM d) AS np, (SELECT SUM(neg) FROM d) AS nn FROM d),
 ap AS (SELECT SUM(pos * tp / (tp + fp)::DOUBLE) / MAX(np) AS average_precision FROM c)"""


@query("roc_auc", f"WITH {SCORED_SQL}, {AUC_SQL} SELECT ROUND(roc_auc, 12) AS roc_auc FROM auc")
def roc_auc(spark, sf):
    return ME.roc_auc(scored(spark, sf), "y", "p").select(F.round("roc_auc", 12).alias("roc_auc"))


@query("average_precision", f"WITH {SCORED_SQL}, {CURVE_SQL} SELECT ROUND(average_precision, 9) AS average_precision FROM ap")
def average_precision(spark, sf):
    return ME.average_precision(scored(spark, sf), "y", "p").select(F.round("average_precision", 9).alias("average_precision"))


@query("roc_curve", f"WITH {SCORED_SQL}, {CURVE_SQL} SELECT p AS threshold, fp / nn::DOUBLE AS fpr, tp / np::DOUBLE AS tpr FROM c")
def roc_curve(spark, sf):
    return ME.roc_curve(scored(spark, sf), "y", "p")


@query("pr_curve", f"WITH {SCORED_SQL}, {CURVE_SQL} SELECT p AS threshold, tp / (tp + fp)::DOUBLE AS precision, tp / np::DOUBLE AS recall FROM c")
def pr_curve(spark, sf):
    return ME.pr_curve(scored(spark, sf), "y", "p")


@query("classification_metrics", f"""WITH {SCORED_SQL}, {AUC_SQL}, {CURVE_SQL}, k AS (SELECT COUNT(*) FILTER (y = 1 AND p >= 0.5) AS tp, COUNT(*) FILTER (y = 0 AND p >= 0.5) AS fp, COUNT(*) FILTER (y = 1 AND p < 0.5) AS fn, COUNT(*) FILTER (y = 0 AND p < 0.5) AS tn,
  AVG((p - y) * (p - y)) AS brier, AVG(-(y * ln(LEAST(GREATEST(p, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - LEAST(GREATEST(p, 1e-7), 1 - 1e-7)))) AS log_loss FROM scored)
  SELECT tp, fp, fn, tn, ROUND(brier, 9) AS brier, ROUND(log_loss, 9) AS log_loss, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy, ROUND((tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2, 9) AS balanced_accuracy, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall,
   2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1, ROUND((2.0::DOUBLE * tp / (2 * tp + fp + fn) + 2.0::DOUBLE * tn / (2 * tn + fp + fn)) / 2, 9) AS f1_macro,
   ROUND((tp::DOUBLE * tn - fp::DOUBLE * fn) / SQRT((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc, (SELECT ROUND(roc_auc, 9) FROM auc) AS roc_auc, (SELECT ROUND(average_precision, 9) FROM ap) AS average_precision FROM k""")
def classification_metrics(spark, sf):
    s = scored(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    m = ME.classification_metrics(s, "y", "pred", "p")
    return m.withColumns({c: F.round(c, 9) for c in ("brier", "log_loss", "balanced_accuracy", "f1_macro", "mcc", "roc_auc", "average_precision")})


REG_SQL = "reg AS (SELECT event_id, value AS y, 20 + value * 0.7::DOUBLE + (event_id % 13) AS p FROM events)"


def regression_frame(spark, sf):
    e = B.table(spark, sf, "events")
    return e.select("event_id", "event_type", F.col("value").alias("y"), (F.col("value") * 0.7 + 20 + F.col("event_id") % 13).alias("p"))


@query("regression_metrics", f"""WITH {REG_SQL} SELECT ROUND(SQRT(AVG((y - p) * (y - p))), 6) AS rmse, ROUND(AVG(ABS(y - p)), 6) AS mae, ROUND(MAX(ABS(y - p)), 6) AS max_error, ROUND(1 - AVG((y - p) * (y - p)) / VAR_POP(y), 6) AS r2,
  ROUND(1 - VAR_POP(y - p) / VAR_POP(y), 6) AS explained_variance, ROUND(AVG(CASE WHEN ABS(y) > 1e-6 THEN ABS((y - p) / y) END) * 100, 6) AS mape, ROUND(quantile_cont(ABS(y - p), 0.5), 6) AS median_ae FROM reg""")
def regression_metrics(spark, sf):
    m = ME.regression_metrics(regression_frame(spark, sf), "y", "p")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("residuals_by_type", f"""WITH r AS (SELECT event_type, value - (20 + value * 0.7::DOUBLE + (event_id % 13)) AS e FROM events) SELECT event_type, COUNT(*) AS n, ROUND(AVG(e), 9) AS mean_residual, ROUND(STDDEV_SAMP(e), 9) AS residual_std FROM r GROUP BY 1""")
def residuals_by_type(spark, sf):
    return ME.residual_table(regression_frame(spark, sf), "y", "p", "event_type").withColumns({"mean_residual": F.round("mean_residual", 9), "residual_std": F.round("residual_std", 9)})


@query("confusion_table", f"""WITH {B.SQL_DELIVERIES}, c AS (SELECT status AS actual, CASE WHEN km > 300 THEN 'failed' WHEN weight_kg > 25 THEN 'delivered' ELSE status END AS predicted FROM deliveries)
  SELECT actual, COUNT(*) FILTER (predicted = 'delivered') AS pred_delivered, COUNT(*) FILTER (predicted = 'delivered_late') AS pred_delivered_late, COUNT(*) FILTER (predicted = 'failed') AS pred_failed, COUNT(*) FILTER (predicted = 'returned') AS pred_returned FROM c GROUP BY 1""")
def confusion_table(spark, sf):
    guess = F.when(F.col("km") > 300, "failed").when(F.col("weight_kg") > 25, "delivered").otherwise(F.col("status"))
    return ME.confusion_table(B.deliveries(spark, sf).withColumn("guess", guess), "status", "guess", ["delivered", "delivered_late", "failed", "returned"])


@query("per_class_metrics", f"""WITH {B.SQL_DELIVERIES}, c AS (SELECT status AS a, CASE WHEN km > 300 THEN 'failed' WHEN weight_kg > 25 THEN 'delivered' ELSE status END AS p FROM deliveries), k AS (SELECT DISTINCT a AS class FROM c)
  SELECT class, s AS support, t AS tp, q AS predicted, t / q::DOUBLE AS precision, t / s::DOUBLE AS recall, t * 2.0::DOUBLE / (q + s) AS f1 FROM (SELECT class, (SELECT COUNT(*) FROM c WHERE a = class) AS s, (SELECT COUNT(*) FROM c WHERE a = class AND p = class) AS t, (SELECT COUNT(*) FROM c WHERE p = class) AS q FROM k)""")
def per_class_metrics(spark, sf):
    guess = F.when(F.col("km") > 300, "failed").when(F.col("weight_kg") > 25, "delivered").otherwise(F.col("status"))
    return ME.per_class(B.deliveries(spark, sf).withColumn("guess", guess), "status", "guess")


@query("calibration_table", f"""WITH {SCORED_SQL} SELECT LEAST(floor(p * 10), 9)::INTEGER AS bin, COUNT(*) AS n, ROUND(AVG(p), 9) AS mean_predicted, AVG(y) AS observed_rate, ROUND(AVG(p) - AVG(y), 9) AS gap FROM scored GROUP BY 1""")
def calibration_table(spark, sf):
    return ME.calibration_table(scored(spark, sf), "y", "p").withColumns({"mean_predicted": F.round("mean_predicted", 9), "gap": F.round("gap", 9)})
