"""Masking, corruption, detection, profiles and cleaning over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chance import hash_uniform, uniform_between
from ..operators import cleaning as C
from ..operators import profile as PR
from ..operators import quality as Q
from . import bind as B
from .registry import query
from .relational_queries import FLAG_SQL, flagged_events, u_sql

R_PCT = "(RANK() OVER (ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE) / COUNT({x}) OVER ()"


def orders(spark, sf):
    return B.table(spark, sf, "orders")


# ---------------------------------------------------------------- missingness


@query("mask_mcar", f"SELECT o_orderkey, {u_sql('missing:o_totalprice', 'o_orderkey')} < 0.1 AS masked FROM orders")
def mask_mcar(spark, sf):
    return Q.mask_mcar(orders(spark, sf), ["o_orderkey"], "o_totalprice", 0.1).select("o_orderkey", F.col("_mask").alias("masked"))


MAR_NUM_SQL = f"""w AS (SELECT o_orderkey, o_totalprice, 0.35::DOUBLE + 1.3::DOUBLE * ({R_PCT.format(x='o_totalprice')}) AS w FROM orders),
 m AS (SELECT o_orderkey, {u_sql('missing:o_custkey', 'o_orderkey')} < LEAST(w * 0.1::DOUBLE / GREATEST((SELECT SUM(w) / COUNT(*) FROM w), 1e-9), 0.98) AS masked FROM w)"""


@query("mask_mar_numeric", f"WITH {MAR_NUM_SQL} SELECT * FROM m")
def mask_mar_numeric(spark, sf):
    return Q.mask_mar(orders(spark, sf), ["o_orderkey"], "o_custkey", "o_totalprice", 0.1).select("o_orderkey", F.col("_mask").alias("masked"))


@query("mask_mar_levels", f"""WITH w AS (SELECT o_orderkey, {u_sql('level:o_totalprice', 'o_orderpriority')} * {2.4 - 0.25!r}::DOUBLE + 0.25::DOUBLE AS w FROM orders)
 SELECT o_orderkey, {u_sql('missing:o_totalprice', 'o_orderkey')} < LEAST(w * 0.2::DOUBLE / GREATEST((SELECT SUM(w) / COUNT(*) FROM w), 1e-9), 0.98) AS masked FROM w""")
def mask_mar_levels(spark, sf):
    out = Q.mask_mar(orders(spark, sf), ["o_orderkey"], "o_totalprice", "o_orderpriority", 0.2, numeric=False)
    return out.select("o_orderkey", F.col("_mask").alias("masked"))


MNAR_SQL = f"""WITH w AS (SELECT event_id, value, 0.15::DOUBLE + 1.85::DOUBLE * (1.0::DOUBLE - {R_PCT.format(x='value')}) AS w FROM events),
 m AS (SELECT event_id, value, {u_sql('missing:value', 'event_id')} < LEAST(w * 0.15::DOUBLE / GREATEST((SELECT SUM(w) / COUNT(*) FROM w), 1e-9), 0.98) AS masked FROM w)"""


@query("mask_mnar_low", f"{MNAR_SQL} SELECT event_id, masked FROM m")
def mask_mnar_low(spark, sf):
    e = B.table(spark, sf, "events")
    return Q.mask_mnar(e, ["event_id"], "value", 0.15, "low").select("event_id", F.col("_mask").alias("masked"))


RULES = [
    Q.MaskRule("o_totalprice", "MCAR", 0.1), Q.MaskRule("o_orderpriority", "MAR", 0.2, driver="o_orderstatus", numeric_driver=False),
    Q.MaskRule("o_custkey", "MNAR", 0.15, direction="high"),
]
_LVL = f"{u_sql('level:o_orderpriority', 'o_orderstatus', seed=43)} * {2.4 - 0.25!r}::DOUBLE + 0.25::DOUBLE"
MASKED_SQL = f"""WITH w AS (SELECT *, {_LVL} AS w1, 0.15::DOUBLE + 1.85::DOUBLE * ({R_PCT.format(x='o_custkey')}) AS w2 FROM orders),
 k AS (SELECT *, {u_sql('missing:o_totalprice', 'o_orderkey')} < RATE0 AS m0,
   {u_sql('missing:o_orderpriority', 'o_orderkey', seed=43)} < LEAST(w1 * RATE1::DOUBLE / (SELECT SUM(w1) / COUNT(*) FROM w), 0.98) AS m1,
   {u_sql('missing:o_custkey', 'o_orderkey', seed=44)} < LEAST(w2 * RATE2::DOUBLE / (SELECT SUM(w2) / COUNT(*) FROM w), 0.98) AS m2 FROM w)"""


def masked_sql(r0=0.1, r1=0.2, r2=0.15):
    return MASKED_SQL.replace("RATE0", str(r0)).replace("RATE1", str(r1)).replace("RATE2", str(r2))


REPORT_SQL = """SELECT 'orders' AS "table", c AS "column", mech AS mechanism, r::DOUBLE AS target_rate, n AS n_missing, t AS n_rows, 0::BIGINT AS n_missing_before, n / t::DOUBLE AS achieved_rate FROM (
  SELECT 'o_totalprice' AS c, 'MCAR' AS mech, {0} AS r, COUNT(*) FILTER (m0) AS n, COUNT(*) AS t FROM {3} UNION ALL SELECT 'o_orderpriority', 'MAR', {1}, COUNT(*) FILTER (m1), COUNT(*) FROM {3}
  UNION ALL SELECT 'o_custkey', 'MNAR', {2}, COUNT(*) FILTER (m2), COUNT(*) FROM {3})"""


def masked(spark, sf):
    return Q.apply_missingness(orders(spark, sf), "orders", ["o_orderkey"], RULES)


@query("masked_orders", masked_sql() + " SELECT o_orderkey, CASE WHEN NOT m0 THEN o_totalprice END AS o_totalprice, CASE WHEN NOT m1 THEN o_orderpriority END AS o_orderpriority, CASE WHEN NOT m2 THEN o_custkey END AS o_custkey FROM k")
def masked_orders(spark, sf):
    return masked(spark, sf)[0].select("o_orderkey", "o_totalprice", "o_orderpriority", "o_custkey")


@query("masked_ground_truth", masked_sql() + """ SELECT 'orders' AS "table", 'o_orderpriority' AS "column", o_orderkey::VARCHAR AS row_key, o_orderpriority AS true_value, 'MAR' AS mechanism FROM k WHERE m1
  UNION ALL SELECT 'orders', 'o_custkey', o_orderkey::VARCHAR, o_custkey::VARCHAR, 'MNAR' FROM k WHERE m2""")
def masked_ground_truth(spark, sf):
    return masked(spark, sf)[1].where("column <> 'o_totalprice'")


@query("missingness_report", masked_sql() + " " + REPORT_SQL.format(0.1, 0.2, 0.15, "k"))
def missingness_report(spark, sf):
    return masked(spark, sf)[2]


SWEEP = [0.01, 0.05, 0.1, 0.2, 0.4]


@query("missingness_sweep", " UNION ALL ".join(f"(SELECT * FROM ({masked_sql(r, r, r)} {REPORT_SQL.format(r, r, r, 'k')}))" for r in SWEEP))
def missingness_sweep(spark, sf):
    return Q.missingness_sweep(orders(spark, sf), "orders", ["o_orderkey"], RULES, SWEEP)


@query("imputation_score", f"""{MNAR_SQL}, f AS (SELECT quantile_cont(value, 0.5) AS med FROM m WHERE NOT masked) SELECT COUNT(*) AS cells, ROUND(AVG(ABS(med - value)), 6) AS mae, ROUND(SQRT(AVG((med - value) * (med - value))), 6) AS rmse,
  ROUND(AVG(med - value), 6) AS bias FROM m, f WHERE masked""")
def imputation_score(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", "value")
    gone, truth, _ = Q.apply_missingness(e, "events", ["event_id"], [Q.MaskRule("value", "MNAR", 0.15, direction="low")])
    filled = C.impute(gone, C.fit_fills(gone, ["value"], []))
    out = Q.score_imputation(filled, truth, ["event_id"], "value")
    return out.select("cells", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias")])


# ---------------------------------------------------------------- injection and detection


@query("injected_rows", f"""WITH h AS (SELECT *, {u_sql('anomaly:cost_outlier', 'o_orderkey')} < 0.02 AS c, {u_sql('anomaly:fraudulent_order', 'o_orderkey')} < 0.05 AND o_orderstatus = 'F' AS f FROM orders)
  SELECT o_orderkey, CASE WHEN f THEN (CASE WHEN c THEN o_totalprice * ({u_sql('factor', 'o_orderkey')} * 78 + 12) ELSE o_totalprice END) * 6 WHEN c THEN o_totalprice * ({u_sql('factor', 'o_orderkey')} * 78 + 12) ELSE o_totalprice END AS o_totalprice,
   CASE WHEN f THEN 'P' ELSE o_orderstatus END AS o_orderstatus, concat_ws(';', CASE WHEN c THEN 'cost_outlier' END, CASE WHEN f THEN 'fraudulent_order' END) AS anomaly_flags FROM h""")
def injected_rows(spark, sf):
    factor = uniform_between(hash_uniform("factor", "o_orderkey"), 12, 90)
    o = Q.inject_rowwise(orders(spark, sf), ["o_orderkey"], "cost_outlier", 0.02, {"o_totalprice": lambda x: x * factor})
    o = Q.inject_rowwise(o, ["o_orderkey"], "fraudulent_order", 0.05, {"o_totalprice": lambda x: x * 6, "o_orderstatus": F.lit("P")}, only=F.col("o_orderstatus") == "F")
    return o.select("o_orderkey", "o_totalprice", "o_orderstatus", "anomaly_flags")


PLACES = ["view", "signup", "error", "click", "purchase"]
WINDOW_SQL = f"""win AS (SELECT r.window_id, {PLACES}[CAST(floor({u_sql('windows:place', 'r.window_id')} * 5) AS BIGINT) + 1] AS place,
   TIMESTAMP '2024-01-01' + CAST(floor({u_sql('windows:start', 'r.window_id')} * 700) AS BIGINT) * INTERVAL 1 HOUR AS start_ts, CAST(floor({u_sql('windows:len', 'r.window_id')} * 67) + 6 AS BIGINT) AS hrs,
   {u_sql('windows:mult', 'r.window_id')} * 4 + 2 AS multiplier FROM (SELECT range AS window_id FROM range(24)) r)"""


@query("injected_windows", f"""WITH {WINDOW_SQL}, hit AS (SELECT event_id, COUNT(*) AS k, SUM(multiplier) AS s FROM events JOIN win ON event_type = place AND ts BETWEEN start_ts AND start_ts + hrs * INTERVAL 1 HOUR GROUP BY 1)
  SELECT event_id, ROUND(CASE WHEN k IS NOT NULL THEN value + s ELSE value END, 9) AS value, COALESCE(rtrim(repeat('demand_spike;', k), ';'), '') AS anomaly_flags FROM events LEFT JOIN hit USING (event_id)""")
def injected_windows(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    w = Q.event_windows(spark, 24, (6, 72), "2024-01-01 00:00:00", 700, PLACES).withColumn("multiplier", F.col("u_mult") * 4 + 2)
    add = lambda v, s: v + F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    out = Q.inject_windows(e, w, "event_type", "ts", "demand_spike", {"value": add}, ["event_id"])
    return out.select("event_id", F.round("value", 9).alias("value"), "anomaly_flags")


DUP_SQL = f"""dup AS (SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey, o_totalprice, o_orderdate, FALSE AS is_duplicate, '' AS anomaly_flags FROM orders UNION ALL
  SELECT o_orderkey || '-DUP', o_custkey, o_totalprice, o_orderdate + (CAST(floor({u_sql('duplicate_shift', 'o_orderkey')} * 239) AS BIGINT) + 1) * INTERVAL 1 SECOND, TRUE, 'duplicate_order' FROM orders WHERE {u_sql('duplicate', 'o_orderkey')} < 0.03)"""


def duplicated(spark, sf):
    return Q.inject_duplicates(orders(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), "o_orderkey", "o_orderdate", 0.03)


query("injected_duplicates", f"WITH {DUP_SQL} SELECT * FROM dup")(duplicated)


@query("detected_duplicates", f"""WITH {DUP_SQL}, g AS (SELECT *, LAG(o_orderdate) OVER w AS prev, LAG(o_orderkey) OVER w AS earlier_id FROM dup WINDOW w AS (PARTITION BY o_custkey, o_totalprice ORDER BY o_orderdate, o_orderkey))
  SELECT o_orderkey, earlier_id, date_diff('second', prev, o_orderdate) AS gap_seconds FROM g WHERE date_diff('second', prev, o_orderdate) <= 240""")
def detected_duplicates(spark, sf):
    from ..operators.ordered import time_bucket

    out = Q.detect_duplicates(duplicated(spark, sf), ["o_custkey", "o_totalprice"], ["o_orderdate", "o_orderkey"], time_bucket("o_orderdate"), "o_orderdate", "o_orderkey")
    return out.select("o_orderkey", "earlier_id", "gap_seconds")


@query("anomaly_report", f"""WITH {FLAG_SQL}, l AS (SELECT unnest(string_split(anomaly_flags, ';')) AS label FROM flags WHERE anomaly_flags <> '')
  SELECT label, COUNT(*) AS rows, COUNT(*) / (SELECT COUNT(*) FROM flags)::DOUBLE AS rate FROM l GROUP BY 1""")
def anomaly_report(spark, sf):
    return Q.anomaly_report(flagged_events(spark, sf))


@query("rule_checks", f"""WITH {B.SQL_DELIVERIES}, c AS (SELECT COUNT(*) FILTER (NOT (km > 0)) AS a, COUNT(*) FILTER (NOT (weight_kg > 0)) AS b, COUNT(*) FILTER (NOT (cost > 0)) AS c, COUNT(*) FILTER (NOT (ship_ts >= order_ts)) AS d, COUNT(*) AS n FROM deliveries)
  SELECT 'positive_distance' AS rule, a AS violations, a / n::DOUBLE AS share FROM c UNION ALL SELECT 'positive_weight', b, b / n::DOUBLE FROM c UNION ALL SELECT 'positive_cost', c, c / n::DOUBLE FROM c
  UNION ALL SELECT 'ordered_times', d, d / n::DOUBLE FROM c""")
def rule_checks(spark, sf):
    return Q.rule_checks(B.deliveries(spark, sf), {
        "positive_distance": F.col("km") > 0, "positive_weight": F.col("weight_kg") > 0, "positive_cost": F.col("cost") > 0, "ordered_times": F.col("ship_ts") >= F.col("order_ts")})


FKS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
       ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
       ("nation", "n_regionkey", "region", "r_regionkey"), ("events", "user_id", "supplier", "s_suppkey")]


@query("fk_report", " UNION ALL ".join(
    f"""SELECT '{c}' AS child, '{fk}' AS "column", '{p}' AS parent, COUNT(*) AS orphans FROM {c} WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {p})""" for c, fk, p, pk in FKS))
def fk_report(spark, sf):
    names = {n for c, _, p, _ in FKS for n in (c, p)}
    return Q.fk_report({n: B.table(spark, sf, n) for n in names}, FKS)


# ---------------------------------------------------------------- profiles


@query("table_profile", """SELECT 'orders' AS "table", COUNT(*) AS rows, 6 AS columns, 0.0::DOUBLE AS missing_cells_pct, 0 AS columns_with_missing, CAST(COUNT(*) - COUNT(DISTINCT o_orderkey) AS BIGINT) AS duplicate_key_rows, 3 AS numeric_columns, 1 AS time_columns FROM orders
  UNION ALL SELECT 'events', COUNT(*), 6, 0.0, 0, CAST(COUNT(*) - COUNT(DISTINCT event_id) AS BIGINT), 3, 1 FROM events
  UNION ALL SELECT 'lineitem', COUNT(*), 11, 0.0, 0, CAST(COUNT(*) - COUNT(DISTINCT l_orderkey) AS BIGINT), 8, 1 FROM lineitem""")
def table_profile(spark, sf):
    t = {n: B.table(spark, sf, n) for n in ("orders", "events", "lineitem")}
    return PR.table_profile(t, {"orders": "o_orderkey", "events": "event_id", "lineitem": "l_orderkey"})


def _num_sql(t, cols, extra=True):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT({c}) AS n, ROUND(AVG({c}), 9) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS std, MIN({c})::DOUBLE AS min, MAX({c})::DOUBLE AS max, COUNT(*) - COUNT({c}) AS n_missing, ROUND(skewness({c}), 6) AS skew, ROUND(kurtosis({c}), 6) AS kurtosis,
        quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS p75, COUNT(DISTINCT {c}) AS n_unique, (COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*) AS missing_pct FROM {t}""" for c in cols)


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]


@query("numeric_profile", _num_sql("lineitem", NUM))
def numeric_profile(spark, sf):
    p = PR.numeric_profile(B.table(spark, sf, "lineitem"), NUM)
    return p.withColumns({c: F.round(c, 9 if c == "mean" else 6) for c in ("mean", "std", "skew", "kurtosis")})


CAT = ["o_orderstatus", "o_orderpriority"]


@query("categorical_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (SELECT COUNT(DISTINCT {c}) FROM orders) AS n_unique, 0.0::DOUBLE AS missing_pct, {c} AS top_value, n * 100.0::DOUBLE / (SELECT COUNT(*) FROM orders) AS top_share_pct
     FROM (SELECT {c}, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, {c} LIMIT 1)""" for c in CAT))
def categorical_profile(spark, sf):
    return PR.categorical_profile(orders(spark, sf), CAT)


@query("data_dictionary")
def data_dictionary(spark, sf):
    return PR.column_profile(B.table(spark, sf, "events"), "events")


@query("missing_rates", masked_sql() + """ , c AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (m0) AS a, COUNT(*) FILTER (m1) AS b, COUNT(*) FILTER (m2) AS c FROM k)
  SELECT 'o_totalprice' AS feature, a * 100.0::DOUBLE / n AS missing_pct FROM c UNION ALL SELECT 'o_orderpriority', b * 100.0::DOUBLE / n FROM c UNION ALL SELECT 'o_custkey', c * 100.0::DOUBLE / n FROM c""")
def missing_rates(spark, sf):
    return PR.missing_rates(masked(spark, sf)[0], ["o_orderkey", "o_totalprice", "o_orderpriority", "o_custkey", "o_orderdate"])


@query("target_distribution", f"""WITH {B.SQL_DELIVERIES}, g AS (SELECT status AS class, COUNT(*) AS count FROM deliveries GROUP BY 1)
  SELECT class, count, count * 100.0::DOUBLE / SUM(count) OVER () AS share_pct, MAX(count) OVER () / GREATEST(MIN(count) OVER (), 1)::DOUBLE AS imbalance_ratio FROM g""")
def target_distribution(spark, sf):
    return PR.target_distribution(B.deliveries(spark, sf), "status")


@query("target_describe", _num_sql("lineitem", ["l_extendedprice"]))
def target_describe(spark, sf):
    d = PR.target_describe(B.table(spark, sf, "lineitem"), "l_extendedprice")
    d = d.withColumns({"n_unique": B.table(spark, sf, "lineitem").agg(F.count_distinct("l_extendedprice")).scalar(), "missing_pct": F.col("n_missing") * 100.0 / (F.col("n") + F.col("n_missing"))})
    return d.withColumns({c: F.round(c, 9 if c == "mean" else 6) for c in ("mean", "std", "skew", "kurtosis")})


ASSOC_NUM, ASSOC_CAT = ["weight_kg", "value", "km", "line_no"], ["domain", "priority", "region"]


@query("target_association", f"""WITH {B.SQL_DELIVERIES}, d AS (SELECT *, is_late::INT::DOUBLE AS y FROM deliveries), r AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 'numeric' AS kind, ABS(corr({c}, y)) AS association, corr({c}, y) AS signed FROM d" for c in ASSOC_NUM) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{c}', 'categorical', (SELECT MAX(m) - MIN(m) FROM (SELECT AVG(y) AS m FROM d GROUP BY {c})) / (SELECT STDDEV_POP(y) FROM d), NULL" for c in ASSOC_CAT) +
    ") SELECT feature, kind, ROUND(association, 9) AS association, ROUND(signed, 9) AS signed FROM r ORDER BY association DESC, feature LIMIT 12")
def target_association(spark, sf):
    out = PR.target_association(B.deliveries(spark, sf).withColumn("y", F.col("is_late").cast("int")), "y", ASSOC_NUM, ASSOC_CAT)
    return out.withColumns({"association": F.round("association", 9), "signed": F.round("signed", 9)})


COR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("correlation_pairs", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, ROUND(corr({a}, {b}), 9) AS corr FROM lineitem" for i, a in enumerate(COR) for b in COR[i + 1:]))
def correlation_pairs(spark, sf):
    return PR.correlation_pairs(B.table(spark, sf, "lineitem"), COR).withColumn("corr", F.round("corr", 9))


@query("high_correlation_pairs", f"""WITH {B.SQL_DELIVERIES}, p AS (SELECT 'cost' AS feature_a, 'labour_cost' AS feature_b, corr(cost, labour_cost) AS c FROM deliveries UNION ALL SELECT 'cost', 'revenue', corr(cost, revenue) FROM deliveries
   UNION ALL SELECT 'labour_cost', 'revenue', corr(labour_cost, revenue) FROM deliveries UNION ALL SELECT 'cost', 'km', corr(cost, km) FROM deliveries UNION ALL SELECT 'labour_cost', 'km', corr(labour_cost, km) FROM deliveries UNION ALL SELECT 'revenue', 'km', corr(revenue, km) FROM deliveries)
  SELECT feature_a, feature_b, ROUND(c, 9) AS corr, ROUND(ABS(c), 9) AS abs_corr FROM p WHERE ABS(c) > 0.9 ORDER BY abs_corr DESC LIMIT 30""")
def high_correlation_pairs(spark, sf):
    return PR.high_pairs(B.deliveries(spark, sf), ["cost", "labour_cost", "revenue", "km"]).withColumns({"corr": F.round("corr", 9), "abs_corr": F.round("abs_corr", 9)})


# ---------------------------------------------------------------- cleaning


@query("missing_indicators", masked_sql() + " SELECT o_orderkey, m0::TINYINT AS o_totalprice__was_missing, m1::TINYINT AS o_orderpriority__was_missing, m2::TINYINT AS o_custkey__was_missing FROM k")
def missing_indicators(spark, sf):
    out = C.missing_indicators(masked(spark, sf)[0], ["o_totalprice", "o_orderpriority", "o_custkey", "o_orderdate"])
    return out.select("o_orderkey", *[c for c in out.columns if c.endswith("__was_missing")])


@query("imputed_orders", masked_sql() + """, f AS (SELECT quantile_cont(o_totalprice, 0.5) FILTER (NOT m0) AS p, quantile_cont(o_custkey::DOUBLE, 0.5) FILTER (NOT m2) AS c FROM k),
  o AS (SELECT o_orderpriority AS v FROM (SELECT o_orderpriority, COUNT(*) AS n FROM k WHERE NOT m1 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1))
  SELECT o_orderkey, CASE WHEN m0 THEN p ELSE o_totalprice END AS o_totalprice, CASE WHEN m1 THEN v ELSE o_orderpriority END AS o_orderpriority, CASE WHEN m2 THEN c ELSE o_custkey::DOUBLE END AS o_custkey FROM k, f, o""")
def imputed_orders(spark, sf):
    df = masked(spark, sf)[0].select("o_orderkey", "o_totalprice", "o_orderpriority", F.col("o_custkey").cast("double").alias("o_custkey"))
    return C.impute(df, C.fit_fills(df, ["o_totalprice", "o_custkey"], ["o_orderpriority"]))


@query("clipped_outliers", "WITH b AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events) SELECT event_id, LEAST(GREATEST(value, lo), hi) AS value FROM events, b")
def clipped_outliers(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", "value")
    return C.clip_quantiles(e, C.fit_bounds(e, ["value"], 0.01))


@query("ordinal_codes", """SELECT o_orderkey, (DENSE_RANK() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS o_orderpriority, (DENSE_RANK() OVER (ORDER BY o_orderstatus) - 1)::INTEGER AS o_orderstatus,
  (DENSE_RANK() OVER (ORDER BY o_orderkey::VARCHAR) - 1)::INTEGER AS order_code FROM orders""")
def ordinal_codes(spark, sf):
    o = orders(spark, sf).select("o_orderkey", *CAT, F.col("o_orderkey").cast("string").alias("order_code"))
    return C.ordinal_encode(o, C.fit_levels(o, [*CAT, "order_code"]))


@query("onehot_codes", """SELECT o_orderkey, (o_orderstatus = 'F')::TINYINT AS o_orderstatus_F, (o_orderstatus = 'O')::TINYINT AS o_orderstatus_O, (o_orderstatus = 'P')::TINYINT AS o_orderstatus_P,
  (DENSE_RANK() OVER (ORDER BY strftime(o_orderdate, '%Y-%m')) - 1)::INTEGER AS month, (DENSE_RANK() OVER (ORDER BY o_custkey::VARCHAR) - 1)::INTEGER AS customer FROM orders""")
def onehot_codes(spark, sf):
    o = orders(spark, sf).select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_custkey").cast("string").alias("customer"))
    return C.onehot_encode(o, C.fit_levels(o, ["o_orderstatus", "month", "customer"]))


@query("constants_dropped", "SELECT event_id, value, nullif(value, 6.55) AS sparse FROM events")
def constants_dropped(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", "value", F.nullif("value", F.lit(6.55)).alias("sparse"), F.lit(1).alias("one"), F.lit(None).cast("int").alias("nothing"))
    return C.drop_constants(e)


@query("clean_table", masked_sql() + """, x AS (SELECT o_orderkey::VARCHAR AS row_id, CASE WHEN NOT m0 THEN o_totalprice END AS o_totalprice, CASE WHEN NOT m1 THEN o_orderpriority END AS o_orderpriority, o_orderstatus FROM k),
  f AS (SELECT quantile_cont(o_totalprice, 0.5) AS p FROM x), o AS (SELECT o_orderpriority AS v FROM (SELECT o_orderpriority, COUNT(*) AS n FROM x WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)),
  i AS (SELECT row_id, (x.o_totalprice IS NULL)::TINYINT AS a, (x.o_orderpriority IS NULL)::TINYINT AS b, COALESCE(o_totalprice, p) AS t, COALESCE(o_orderpriority, v) AS q, o_orderstatus FROM x, f, o), c AS (SELECT quantile_cont(t, 0.01) AS lo, quantile_cont(t, 0.99) AS hi FROM i)
  SELECT row_id, a AS o_totalprice__was_missing, b AS o_orderpriority__was_missing, LEAST(GREATEST(t, lo), hi) AS o_totalprice, (DENSE_RANK() OVER (ORDER BY q) - 1)::INTEGER AS o_orderpriority, (DENSE_RANK() OVER (ORDER BY o_orderstatus) - 1)::INTEGER AS o_orderstatus FROM i, c""")
def clean_table(spark, sf):
    df = masked(spark, sf)[0].select(F.col("o_orderkey").cast("string").alias("row_id"), "o_totalprice", "o_orderpriority", "o_orderstatus", F.lit(7).alias("constant"), F.lit(1.0).alias("margin_usd"))
    return C.clean_table(df, ["margin_usd"])[0]


@query("replayed_cleaning")
def replayed_cleaning(spark, sf):
    df = masked(spark, sf)[0].select(F.col("o_orderkey").cast("string").alias("row_id"), "o_totalprice", "o_orderpriority", "o_orderstatus")
    meta = C.load_meta(C.save_meta(C.clean_table(df, [])[1]))
    return C.replay(df.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "new").otherwise(F.col("o_orderstatus"))), meta)




@query("level_code_table", "SELECT o_orderpriority AS level, ROW_NUMBER() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def level_code_table(spark, sf):
    return C.level_codes(orders(spark, sf), "o_orderpriority")
