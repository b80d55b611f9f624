"""Models, clusters, explanations, scoring and streams."""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.chance import hash_uniform
from ..operators import clustering as CL
from ..operators import explain as EX
from ..operators import metrics as ME
from ..operators import models as MO
from ..operators.marts import results_mart as results_mart_tables
from ..operators.tree_shapley import tree_shapley
from ..session import kept
from ..streaming import streams as ST
from . import bind as B
from .feature_queries import TEMPORAL_SQL, temporal
from .registry import query

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "p_size", "p_retailprice", "order_month"]
CAT = ["c_mktsegment", "o_orderpriority"]
NAMES = NUM + CAT


def line_rows(spark, sf, keep=()):
    """Lines with the columns ``keep``, features in the types of their tables and a label, split by order time."""
    l, p = B.table(spark, sf, "lineitem"), B.table(spark, sf, "part")
    o = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(temporal(spark, sf).select("o_orderkey", "split"), "o_orderkey")
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    odd = hash_uniform("label_noise", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]) < 0.1
    # what the keys tell is worked out first, so that they need not go through the joins
    l = l.select(*keep, key.alias("line_id"), odd.alias("_odd"), "l_orderkey", "l_partkey", *[c for c in NUM if c.startswith("l_")])
    o = o.select("o_orderkey", "split", F.month("o_orderdate").alias("order_month"), *CAT)
    risky = (F.col("l_extendedprice") * (1 + F.col("l_tax")) > 50000) | (F.col("o_orderpriority") == "1-URGENT")
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(p.select("p_partkey", "p_size", "p_retailprice"), l.l_partkey == F.col("p_partkey"))
    return rows.select(*[F.col(c) for c in l.columns[: len(keep)]], "line_id", "split", *NUM, *CAT, (risky != F.col("_odd")).alias("label"))


def model_rows(rows, keep=()):
    """Rows of ``line_rows`` as models take them: features and the high-value label of classification as doubles, and the price for regression."""
    doubles = [F.col(c).cast("double").alias(c) for c in NUM]
    return rows.select(*keep, "line_id", "split", *doubles, *CAT, F.col("label").cast("double").alias("label"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"))


def training_rows(spark, sf, keep=()):
    """Lines with the columns ``keep`` and features, split by order time: a high-value label for classification, the price for regression."""
    rows = line_rows(spark, sf, keep)
    return model_rows(rows, rows.columns[: len(keep)])


@lru_cache(maxsize=4)
def _prepared(spark, sf):
    # the tables are joined once, for the steps of preparing and for its result
    rows = model_rows(kept(line_rows(spark, sf), "lines"))
    pre = MO.fit_preprocessor(rows.where("split = 'train'"), NUM, CAT)
    out = MO.class_weights(pre.transform(rows).select("line_id", "split", "label", "net_price", "features"), "label")
    # fits pass over the rows many times: spread them once, over all cores and so that a part stays of one size
    return out.repartition(MO.parts_for(spark, B.table(spark, sf, "lineitem").count())).persist(), pre


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_PREPARED_SQL = f"""WITH {TEMPORAL_SQL}, fr AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, split, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber::DOUBLE AS line_no, p_size::DOUBLE AS p_size, p_retailprice, month(orders.o_orderdate)::DOUBLE AS order_month, c_mktsegment, o_orderpriority
   FROM lineitem JOIN temporal ON l_orderkey = temporal.o_orderkey JOIN orders ON l_orderkey = orders.o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
  m AS (SELECT {", ".join(f"AVG({c}) AS a_{c}, STDDEV_SAMP({c}) AS s_{c}" for c in [n.replace("l_linenumber", "line_no") for n in NUM])} FROM fr WHERE split = 'train'),
  {", ".join(f"{c}_codes AS (SELECT {c}, ROW_NUMBER() OVER (ORDER BY {c}) - 1 AS {c}_code FROM (SELECT DISTINCT {c} FROM fr WHERE split = 'train'))" for c in CAT)}
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, split, {", ".join(f"ROUND(({c} - a_{c}) / s_{c}, 6) AS f{i}" for i, c in enumerate([n.replace("l_linenumber", "line_no") for n in NUM]))},
   {", ".join(f"COALESCE({c}_code, (SELECT COUNT(*) FROM {c}_codes))::DOUBLE AS f{len(NUM) + i}" for i, c in enumerate(CAT))} FROM fr CROSS JOIN m {" ".join(f"LEFT JOIN {c}_codes USING ({c})" for c in CAT)}"""


@query("prepared_features", _PREPARED_SQL)
def prepared_features(spark, sf):
    """What the preprocessor, fitted on the train side only, makes of every row."""
    rows = training_rows(spark, sf, [F.col(c).alias(f"key_{c}") for c in _LINE])
    pre = MO.fit_preprocessor(rows.where("split = 'train'"), NUM, CAT)
    x = vector_to_array("features")
    values = [F.round(F.get("x", F.lit(i)), 6).alias(f"f{i}") for i in range(len(NAMES))]
    return pre.transform(rows).withColumn("x", x).select(*[F.col(f"key_{c}").alias(c) for c in _LINE], "split", *values)


FAST = {
    "logistic_regression": {"maxIter": 30}, "decision_tree": {"maxDepth": 6}, "random_forest": {"numTrees": 20, "maxDepth": 6},
    "gradient_boosting": {"maxIter": 10, "maxDepth": 4}, "svm": {"maxIter": 20}, "mlp": {"maxIter": 30, "layers": [10, 16, 2]},
}
METRICS = ["model", "rank", "accuracy", "f1", "roc_auc", "average_precision", "notes"]


@query("model_leaderboard")
def model_leaderboard(spark, sf):
    return MO.benchmark(_prepared(spark, sf)[0], "binary", FAST)[0].select(*METRICS)


@query("regression_leaderboard")
def regression_leaderboard(spark, sf):
    rows = _prepared(spark, sf)[0].withColumn("label", F.col("net_price"))
    models = {"linear_regression": {}, "decision_tree": {"maxDepth": 6}, "random_forest": {"numTrees": 20, "maxDepth": 6}, "gradient_boosting": {"maxIter": 10, "maxDepth": 4}}
    return MO.benchmark(rows, "regression", models)[0].select("model", "rank", "rmse", "mae", "r2", "median_ae", "notes")


@query("multiclass_leaderboard")
def multiclass_leaderboard(spark, sf):
    rows = _prepared(spark, sf)[0].withColumn("label", F.when(F.col("net_price") < 20000, 0.0).when(F.col("net_price") < 45000, 1.0).otherwise(2.0))
    rows = MO.class_weights(rows.drop("weight"), "label")
    return MO.benchmark(rows, "multiclass", {"random_forest": {"numTrees": 10, "maxDepth": 5}, "gradient_boosting": {"maxIter": 3, "maxDepth": 3}, "logistic_regression": {"maxIter": 20}})[0].select("model", "rank", "accuracy", "f1_macro", "notes")


@lru_cache(maxsize=4)
def _tree(spark, sf):
    return MO.fit_model("random_forest", _prepared(spark, sf)[0], "binary", FAST["random_forest"])


@lru_cache(maxsize=4)
def _boosted(spark, sf):
    return MO.fit_model("gradient_boosting", _prepared(spark, sf)[0], "binary", FAST["gradient_boosting"])


@lru_cache(maxsize=4)
def _logit(spark, sf):
    return MO.fit_model("logistic_regression", _prepared(spark, sf)[0], "binary", FAST["logistic_regression"])


@query("calibrated_model")
def calibrated_model(spark, sf):
    rows, f = _prepared(spark, sf)[0], _tree(spark, sf)
    iso = MO.calibrate(f, rows.where("split = 'val'"))
    return ME.calibration_table(MO.apply_calibration(iso, MO.score(f, rows.where("split = 'test'"))), "label", "calibrated")


@query("native_importance")
def native_importance(spark, sf):
    return MO.native_importance(_tree(spark, sf), NAMES, spark)


@query("class_weights", "SELECT o_orderkey, (SELECT COUNT(*) FROM orders) / (3 * COUNT(*) OVER (PARTITION BY o_orderstatus))::DOUBLE AS weight FROM orders")
def class_weights(spark, sf):
    return MO.class_weights(B.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus").select("o_orderkey", "weight")


@query("split_guard", f"""WITH {TEMPORAL_SQL}, p AS (SELECT split, o_orderstatus, COUNT(*) AS c FROM temporal JOIN orders USING (o_orderkey) GROUP BY 1, 2)
  SELECT split, COUNT(*) AS classes, MIN(c) AS rarest, CASE WHEN split = 'train' AND COUNT(*) < 2 THEN 'skip: one class in train' WHEN COUNT(*) < 2 THEN 'warn: ranking metrics undefined' WHEN MIN(c) < 10 THEN 'warn: rare class' ELSE 'ok' END AS verdict FROM p GROUP BY 1""")
def split_guard(spark, sf):
    rows = temporal(spark, sf).join(B.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return MO.split_guard(rows, "o_orderstatus")


@query("batch_scores")
def batch_scores(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = training_rows(spark, sf)
    path = f"{ST.work_folder(spark)}/model"
    features = NUM[:5]
    Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), LogisticRegression(maxIter=20)]).fit(rows.where("split = 'train'")).write().overwrite().save(path)
    return MO.batch_score(rows.where("split = 'test'").select("line_id", *reversed(features[:4])), path, features)[0]


@query("results_mart")
def results_mart(spark, sf):
    """The stored results a page shows: an absent table is left out."""
    tables = {"leaderboard": multiclass_leaderboard(spark, sf), "importance": native_importance(spark, sf), "plans": None}
    shown = {"leaderboard": (["model", "rank", "f1_macro"], ["rank"], 5), "importance": (["feature", "rank"], ["rank"], 8), "plans": (["problem"], ["problem"], 5)}
    kept = results_mart_tables(tables, shown)
    assert "plans" not in kept
    return kept["leaderboard"].unionByName(kept["importance"].withColumnRenamed("feature", "model"), allowMissingColumns=True)


# ---------------------------------------------------------------- nearest neighbours

EMB_D = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))))"


def embeddings(spark, sf):
    return B.table(spark, sf, "embeddings")


@query("nearest_vectors", f"""WITH d AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, {EMB_D} AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
  r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM d) SELECT query, neighbour, ROUND(distance, 9) AS distance, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def nearest_vectors(spark, sf):
    e = embeddings(spark, sf)
    return CL.nearest_neighbours(e, e, "vec_id", "embedding", 10).withColumn("distance", F.round("distance", 9))


@query("knn_labels", f"""WITH d AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, b.label AS l, {EMB_D} AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
  r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM d), v AS (SELECT query, l, SUM(1 / GREATEST(distance, 1e-12)) AS w FROM r WHERE rank <= 25 GROUP BY 1, 2)
  SELECT query, arg_max(l, (w, -l)) AS predicted, ROUND(MAX(w), 6) AS support FROM v GROUP BY 1""")
def knn_labels(spark, sf):
    e = embeddings(spark, sf)
    return CL.knn_predict(CL.nearest_neighbours(e, e, "vec_id", "embedding", 25), e, "vec_id", "label").withColumn("support", F.round("support", 6))


# ---------------------------------------------------------------- clusters and components


@lru_cache(maxsize=4)
def _vectors(spark, sf):
    return CL.standardise(CL.vector_frame(embeddings(spark, sf), "embedding")).select("vec_id", "label", "features", "z").persist()


@query("kmeans_sweep")
def kmeans_sweep(spark, sf):
    return CL.kmeans_sweep(_vectors(spark, sf), "z", range(2, 6))[0]


@lru_cache(maxsize=4)
def _clusters(spark, sf):
    from pyspark.ml.clustering import KMeans

    v = _vectors(spark, sf)
    return KMeans(featuresCol="z", predictionCol="cluster", k=4, seed=42).fit(v).transform(v)


@query("kmeans_profile")
def kmeans_profile(spark, sf):
    return CL.cluster_profile(_clusters(spark, sf), "z", "cluster", [f"d{i}" for i in range(64)])


@query("kmeans_sizes")
def kmeans_sizes(spark, sf):
    return CL.cluster_sizes(_clusters(spark, sf), "cluster")


CENT_SQL = """x AS (SELECT vec_id, label AS k, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i)), c AS (SELECT k, i, AVG(v) AS c, COUNT(*) AS n FROM x GROUP BY 1, 2), g AS (SELECT i, AVG(v) AS g FROM x GROUP BY 1),
 d AS (SELECT vec_id, x.k, SUM((v - c) * (v - c)) AS d2 FROM x JOIN c ON x.k = c.k AND x.i = c.i GROUP BY 1, 2), s AS (SELECT k, AVG(SQRT(d2)) AS s FROM d GROUP BY 1),
 w AS (SELECT SUM(d2) AS w, COUNT(*) AS n FROM d), b AS (SELECT SUM(n * (c - g) * (c - g)) AS b, COUNT(DISTINCT k) AS k FROM c JOIN g USING (i)),
 m AS (SELECT p.k AS a, q.k AS b, SQRT(SUM((p.c - q.c) * (p.c - q.c))) AS m FROM c p JOIN c q ON p.i = q.i AND p.k <> q.k GROUP BY 1, 2), r AS (SELECT a, MAX((sa.s + sb.s) / m) AS r FROM m JOIN s sa ON sa.k = a JOIN s sb ON sb.k = m.b GROUP BY 1)"""


@query("cluster_quality", f"WITH {CENT_SQL} SELECT b.k AS k, w.n AS n, ROUND((b.b / (b.k - 1)) / (w.w / (w.n - b.k)), 6) AS calinski_harabasz, (SELECT ROUND(AVG(r), 6) FROM r) AS davies_bouldin FROM b, w")
def cluster_quality(spark, sf):
    out = CL.centroid_quality(CL.vector_frame(embeddings(spark, sf), "embedding"), "features", "label")
    return out.withColumns({c: F.round(c, 6) for c in ("calinski_harabasz", "davies_bouldin")})


@lru_cache(maxsize=4)
def _pca(spark, sf):
    return CL.fit_pca(_vectors(spark, sf), "z", 10)


@query("mixture_sweep")
def mixture_sweep(spark, sf):
    return CL.gmm_sweep(_pca(spark, sf).transform(_vectors(spark, sf)).select("pcs"), "pcs", range(2, 5))


@query("pca_variance")
def pca_variance(spark, sf):
    _vectors(spark, sf)
    return CL.pca_variance(_pca(spark, sf), spark)


@query("pca_loadings")
def pca_loadings(spark, sf):
    return CL.pca_loadings(_pca(spark, sf), [f"d{i}" for i in range(64)], spark)


@query("reconstruction_errors")
def reconstruction_errors(spark, sf):
    return CL.error_summary(CL.reconstruction_error(_vectors(spark, sf), "z", _pca(spark, sf)))


def _isolated(spark, sf):
    e = embeddings(spark, sf)
    nodes = CL.isolation_forest(e, "vec_id", "embedding", trees=50, sample=128)
    return CL.flag_anomalies(CL.isolation_scores(e.select("vec_id", "embedding"), "embedding", nodes))


@query("isolation_scores")
def isolation_scores(spark, sf):
    return _isolated(spark, sf).select("vec_id", "anomaly_score", "is_anomaly")


@query("isolation_summary")
def isolation_summary(spark, sf):
    return CL.score_summary(_isolated(spark, sf))


def _planar(spark, sf):
    e = B.table(spark, sf, "events")
    return e.select("event_id", (F.hour("ts") + F.minute("ts") / 60.0).alias("px_hour"), (F.col("value") / 10).alias("py_value"))


_CLUSTER_SQL = """WITH RECURSIVE p AS MATERIALIZED (SELECT event_id, hour(ts) + minute(ts) / 60.0::DOUBLE AS x, value / 10 AS y FROM events),
  k AS MATERIALIZED (SELECT a.event_id, a.x, a.y, floor(a.x / (0.4::DOUBLE / sqrt(2)))::BIGINT || ':' || floor(a.y / (0.4::DOUBLE / sqrt(2)))::BIGINT AS cell FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.4::DOUBLE * 0.4::DOUBLE GROUP BY 1, 2, 3, 4 HAVING COUNT(*) >= 12),
  e AS MATERIALIZED (SELECT DISTINCT a.cell AS s, b.cell AS t FROM k a JOIN k b ON a.cell <> b.cell AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.4::DOUBLE * 0.4::DOUBLE),
  c(cell, root) AS (SELECT DISTINCT cell, cell FROM k UNION SELECT e.t, c.root FROM c JOIN e ON e.s = c.cell),
  l AS (SELECT cell, MIN(root) AS label FROM c GROUP BY 1), n AS (SELECT label, ROW_NUMBER() OVER (ORDER BY label) - 1 AS cluster FROM (SELECT DISTINCT label FROM l)),
  b AS (SELECT p.event_id, MIN(l.label) AS label FROM p JOIN k ON (p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y) <= 0.4::DOUBLE * 0.4::DOUBLE JOIN l USING (cell) WHERE p.event_id NOT IN (SELECT event_id FROM k) GROUP BY 1),
  a AS (SELECT event_id, TRUE AS is_core, label FROM k JOIN l USING (cell) UNION ALL SELECT event_id, FALSE, label FROM b)
  SELECT event_id, COALESCE(is_core, FALSE) AS is_core, COALESCE(cluster, -1)::BIGINT AS cluster FROM p LEFT JOIN a USING (event_id) LEFT JOIN n USING (label)"""


@query("density_clusters", _CLUSTER_SQL)
def density_clusters(spark, sf):
    return CL.dbscan(_planar(spark, sf), "event_id", "px_hour", "py_value", 0.4, 12)


@query("density_core_points", """WITH p AS (SELECT event_id, hour(ts) + minute(ts) / 60.0::DOUBLE AS x, value / 10 AS y FROM events)
  SELECT a.event_id, COUNT(*) >= 12 AS is_core FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.4::DOUBLE * 0.4::DOUBLE GROUP BY 1""")
def density_core_points(spark, sf):
    return CL.core_points(_planar(spark, sf), "event_id", "px_hour", "py_value", 0.4, 12)


# ---------------------------------------------------------------- explanations


def _test_rows(spark, sf, few=None):
    """The whole test side; ``few`` names the first rows by key, for reports on single rows."""
    rows = EX.feature_rows(_prepared(spark, sf)[0].where("split = 'test'"), "line_id", "label")
    return rows.orderBy("row_id").limit(few) if few else rows


@query("permutation_importance")
def permutation_importance(spark, sf):
    return EX.permutation_importance(_test_rows(spark, sf), EX.predictor(_tree(spark, sf)), NAMES)


@query("partial_dependence")
def partial_dependence(spark, sf):
    return EX.partial_dependence(_test_rows(spark, sf), EX.predictor(_tree(spark, sf)), NAMES, ["l_extendedprice", "l_tax", "o_orderpriority"])


@query("linear_attributions")
def linear_attributions(spark, sf):
    f = _logit(spark, sf)
    return EX.global_attribution(EX.linear_shapley(_test_rows(spark, sf), f.model.coefficients, NAMES))


@query("sampled_attributions")
def sampled_attributions(spark, sf):
    return EX.global_attribution(EX.sampled_shapley(_test_rows(spark, sf), EX.predictor(_tree(spark, sf)), NAMES, orders=5))


@query("tree_attributions")
def tree_attributions(spark, sf):
    return EX.global_attribution(tree_shapley(_test_rows(spark, sf), _tree(spark, sf), NAMES))


# every row of the test side has one value a feature, and they add up to its score less the mean
_TEST_LINES = f"WITH {TEMPORAL_SQL} SELECT COUNT(*) AS n FROM lineitem JOIN temporal ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN orders USING (o_orderkey) JOIN customer ON o_custkey = c_custkey WHERE split = 'test'"


def _sums(spark, sf, fitted):
    told = tree_shapley(_test_rows(spark, sf), fitted, NAMES)
    # rows may share a key only if they share their features, and so their values
    rows = told.groupBy("row_id").agg((F.count(F.lit(1)) / len(NAMES)).cast("long").alias("n"), F.sum("shap").alias("s"), F.first("score").alias("score"), F.first("base").alias("base"))
    fine = F.abs(F.col("s") / F.col("n") - (F.col("score") - F.col("base"))) < 1e-9
    return rows.agg(F.sum("n").alias("rows_explained"), F.sum(F.when(fine, F.col("n"))).alias("rows_that_add_up"))


@query("tree_attribution_sums", f"SELECT n AS rows_explained, n AS rows_that_add_up FROM ({_TEST_LINES})")
def tree_attribution_sums(spark, sf):
    return _sums(spark, sf, _tree(spark, sf))


@query("boosted_attribution_sums", f"SELECT n AS rows_explained, n AS rows_that_add_up FROM ({_TEST_LINES})")
def boosted_attribution_sums(spark, sf):
    return _sums(spark, sf, _boosted(spark, sf))


@query("local_attributions")
def local_attributions(spark, sf):
    return EX.local_attribution(tree_shapley(_test_rows(spark, sf, 5), _tree(spark, sf), NAMES))


@query("local_surrogates")
def local_surrogates(spark, sf):
    train = EX.feature_rows(_prepared(spark, sf)[0].where("split = 'train'"), "line_id")
    return EX.local_surrogate(train, _test_rows(spark, sf, 3), EX.predictor(_tree(spark, sf)), NAMES)


@query("attribution_agreement")
def attribution_agreement(spark, sf):
    """How far the exact attributions and the permutation ranking of one model agree."""
    return EX.ranking_agreement(tree_attributions(spark, sf), permutation_importance(spark, sf), "mean_abs", "importance_mean")


@query("ranking_agreement", """WITH a AS (SELECT p_brand AS feature, COUNT(*) AS n FROM part GROUP BY 1), b AS (SELECT p_brand AS feature, COUNT(*) AS m FROM part WHERE p_size > 25 GROUP BY 1),
  j AS (SELECT feature, n, m, RANK() OVER (ORDER BY n DESC) + (COUNT(*) OVER (PARTITION BY n) - 1) / 2.0::DOUBLE AS rank_a, RANK() OVER (ORDER BY m DESC) + (COUNT(*) OVER (PARTITION BY m) - 1) / 2.0::DOUBLE AS rank_b FROM a JOIN b USING (feature))
  SELECT *, ABS(rank_a - rank_b) AS rank_gap, ROUND((SELECT corr(rank_a, rank_b) FROM j), 9) AS spearman FROM j""")
def ranking_agreement(spark, sf):
    p = B.table(spark, sf, "part").withColumnRenamed("p_brand", "feature")
    a, b = p.groupBy("feature").agg(F.count(F.lit(1)).alias("n")), p.where("p_size > 25").groupBy("feature").agg(F.count(F.lit(1)).alias("m"))
    return EX.ranking_agreement(a, b, "n", "m").withColumn("spearman", F.round("spearman", 9))


# ---------------------------------------------------------------- streams


@query("stream_windowed_volume", """WITH w AS (SELECT date_trunc('hour', ts) AS window_start, event_type, COUNT(*) AS n, SUM(CAST(value AS DECIMAL(18,4)))::DOUBLE / COUNT(*) AS mean_value FROM events GROUP BY 1, 2)
  SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, n, mean_value FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_windowed_volume(spark, sf):
    out = ST.run_to_table(ST.windowed_volume(ST.event_stream(spark, sf, "events"), "ts", "event_type", "value"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("stream_without_repeats", "SELECT event_id, user_id, event_type FROM events")
def stream_without_repeats(spark, sf):
    return ST.run_to_table(ST.drop_repeats(ST.event_stream(spark, sf, "events"), ["event_id"], "ts").select("event_id", "user_id", "event_type"))


@query("stream_latest_per_user", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def stream_latest_per_user(spark, sf):
    return ST.run_to_table(ST.latest_per_key(ST.event_stream(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_id", "value"]), "update", ["user_id"]).drop("_at")


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT user_id, ts, SUM(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
  , e AS (SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 6 HOUR AS session_end, COUNT(*) AS n FROM k GROUP BY user_id, k) SELECT * FROM e WHERE session_end <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_sessions(spark, sf):
    out = ST.run_to_table(ST.activity_sessions(ST.event_stream(spark, sf, "events"), "user_id", "ts", "6 hours"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
