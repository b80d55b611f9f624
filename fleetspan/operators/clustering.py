"""Clustering, components and anomaly scores."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chance import hash_uniform
from ..session import cut_lineage
from .quantiles import exact_quantiles


def vector_frame(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def standardise(df: DataFrame, c: str = "features", out: str = "z") -> DataFrame:
    return StandardScaler(inputCol=c, outputCol=out, withMean=True, withStd=True).fit(df).transform(df)


def sq_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


# ---------------------------------------------------------------- quality


def centroid_quality(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin from per-cluster means; NULL below two clusters or ten rows.

    Centroids are one row per cluster; the facts meet only their own centroid.
    """
    rows = df.where(F.col(cluster) >= 0).select(F.col(cluster).alias("_k"), F.col(features).alias("_f"))
    cents = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), vector_to_array(Summarizer.mean(F.col("_f"))).alias("_c"))
    overall = rows.agg(vector_to_array(Summarizer.mean(F.col("_f"))).alias("g")).scalar()
    dist = rows.join(cents, "_k").select("_k", "_n", "_c", sq_distance(vector_to_array("_f"), "_c").alias("_d"))
    per = dist.groupBy("_k").agg(F.first("_n").alias("n"), F.first("_c").alias("c"), F.sum("_d").alias("w"), F.avg(F.sqrt("_d")).alias("s"))
    per = per.withColumn("_g", overall).withColumn("b", F.col("n") * sq_distance("c", "_g"))
    packed = per.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("b").alias("b"), F.array_sort(F.collect_list(F.struct("_k", "c", "s"))).alias("p"))
    ratio = lambda x, y: F.try_divide(x["s"] + y["s"], F.sqrt(sq_distance(x["c"], y["c"])))
    worst = F.transform("p", lambda x: F.array_max(F.transform(F.filter("p", lambda y: y["_k"] != x["_k"]), lambda y: ratio(x, y))))
    valid = (F.col("k") >= 2) & (F.col("n") >= 10)
    ch = F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k")))
    db = F.aggregate(worst, F.lit(0.0), lambda s, v: s + v) / F.col("k")
    return packed.select("k", "n", F.when(valid, ch).alias("calinski_harabasz"), F.when(valid, db).alias("davies_bouldin"))


def silhouette(df: DataFrame, features: str, cluster: str) -> float | None:
    rows = df.where(F.col(cluster) >= 0)
    if rows.select(cluster).distinct().limit(2).count() < 2:
        return None
    return ClusteringEvaluator(featuresCol=features, predictionCol=cluster).evaluate(rows)


def kmeans_sweep(df: DataFrame, features: str, ks: Sequence[int] = range(2, 9), seed: int = 42):
    """Inertia and quality per k, and the model with the best silhouette."""
    rows, best = None, (None, -2.0)
    for k in ks:
        model = KMeans(featuresCol=features, predictionCol="cluster", k=k, seed=seed, maxIter=30).fit(df)
        made = model.transform(df)
        s = silhouette(made, features, "cluster")
        q = centroid_quality(made, features, "cluster").select(
            F.lit(k).alias("k"), F.lit(float(model.summary.trainingCost)).alias("inertia"), F.lit(s).cast("double").alias("silhouette"), "calinski_harabasz", "davies_bouldin")
        rows = q if rows is None else rows.unionByName(q)
        if s is not None and s > best[1]:
            best = (model, s)
    return rows, best[0]


def gmm_sweep(df: DataFrame, features: str, ks: Sequence[int] = range(2, 7), seed: int = 42) -> DataFrame:
    """BIC and AIC of full-covariance mixtures; lowest BIC first."""
    n = df.count()
    d = len(df.select(features).first()[0])
    out = []
    for k in ks:
        ll = GaussianMixture(featuresCol=features, k=k, seed=seed, maxIter=100).fit(df).summary.logLikelihood
        p = k - 1 + k * d + k * d * (d + 1) // 2
        out.append((k, float(p * math.log(n) - 2 * ll), float(2 * p - 2 * ll)))
    return df.sparkSession.createDataFrame(sorted(out, key=lambda r: r[1]), "k int, bic double, aic double")


def cluster_profile(df: DataFrame, features: str, cluster: str, names: Sequence[str], top: int = 12) -> DataFrame:
    """Cluster means of the features that separate clusters most."""
    arr = vector_to_array(features)
    long = df.select(cluster, F.posexplode(arr).alias("_i", "_v")).groupBy(cluster, "_i").agg(F.avg("_v").alias("mean"))
    spread = long.groupBy("_i").agg((F.max("mean") - F.min("mean")).alias("spread")).orderBy(F.col("spread").desc(), "_i").limit(top)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1)
    return long.join(spread, "_i").select(cluster, label.alias("feature"), "mean", "spread")


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).withColumn("_t", total).select(cluster, "n", (F.col("n") * 100 / F.col("_t")).alias("share_pct"))


# ---------------------------------------------------------------- components


def fit_pca(df: DataFrame, features: str, k: int):
    return PCA(inputCol=features, outputCol="pcs", k=k).fit(df)


def pca_variance(model, spark: SparkSession) -> DataFrame:
    """Explained share per component, running total and the component that reaches 90 %."""
    share = [float(x) for x in model.explainedVariance.toArray()]
    total, rows = 0.0, []
    for i, s in enumerate(share):
        rows.append((f"PC{i + 1}", s, total + s, total < 0.9 <= total + s))
        total += s
    return spark.createDataFrame(rows, "component string, explained double, cumulative double, reaches_90 boolean")


def pca_loadings(model, names: Sequence[str], spark: SparkSession, top: int = 20) -> DataFrame:
    pc = model.pc.toArray()
    rows = [(n, float(pc[i, 0]), float(pc[i, 1]), float(abs(pc[i, 0]) + abs(pc[i, 1]))) for i, n in enumerate(names)]
    return spark.createDataFrame(sorted(rows, key=lambda r: -r[3])[:top], "feature string, pc1 double, pc2 double, magnitude double")


def reconstruction_error(df: DataFrame, centred: str, model) -> DataFrame:
    """Mean squared error of rebuilding each centred row from its components.

    The components are orthonormal, so the error is the lost part of the squared length.
    """
    length = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda s, v: s + v * v)
    d = F.size(vector_to_array(centred))
    return model.transform(df).withColumn("error", F.greatest(length(centred) - length("pcs"), F.lit(0.0)) / d)


def error_summary(df: DataFrame, error: str = "error") -> DataFrame:
    """Median, p95, p99 and the number of rows above p99."""
    q = exact_quantiles(df, [], error, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    above = df.withColumn("_c", q.select("p99").scalar()).agg(F.count_if(F.col(error) > F.col("_c"))).scalar()
    return q.withColumn("above_p99", above)


# ---------------------------------------------------------------- isolation forest


def _grow(tree: int, x: np.ndarray, seed: int) -> list[tuple]:
    """Random splits until a node is alone or deep enough; nodes as (tree, node, feature, cut, left, right, size)."""
    rng = np.random.default_rng([seed, tree])
    limit = int(math.ceil(math.log2(max(len(x), 2))))
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    free = 1
    while todo:
        me, rows, depth = todo.pop()
        span = np.ptp(x[rows], axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
        if depth >= limit or not (span > 0).any():
            nodes.append((tree, me, -1, 0.0, -1, -1, len(rows)))
            continue
        f = int(rng.choice(np.flatnonzero(span > 0)))
        cut = float(rng.uniform(x[rows, f].min(), x[rows, f].max()))
        low = x[rows, f] < cut
        nodes.append((tree, me, f, cut, free, free + 1, len(rows)))
        todo += [(free, rows[low], depth + 1), (free + 1, rows[~low], depth + 1)]
        free += 2
    return nodes


def _mean_path(n):
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def isolation_forest(df: DataFrame, key: str, array: str, trees: int = 200, sample: int = 256, seed: int = 42) -> DataFrame:
    """Nodes of all trees. Each tree is grown in one task from the ``sample`` rows of the least hash of (tree, key).

    A row enters the draw of a tree if its hash is below a bound that lets through ``sample`` rows and six deviations more,
    so few rows are moved; the least ``sample`` of these are taken. The draw doesn't depend on partitions or the table's size.
    """
    n = max(df.count(), 1)
    bound = (sample + 6 * math.sqrt(sample) + 36) / n
    drawn = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long")), lambda t: F.struct(t.alias("tree"), hash_uniform("iforest", [t, F.col(key)], seed).alias("u"))), lambda s: s["u"] < bound)
    hit = df.select(key, F.col(array).cast("array<double>").alias("x"), F.explode(drawn).alias("_t")).select(key, "x", "_t.*")
    dealt = hit.withColumn("_r", F.row_number().over(Window.partitionBy("tree").orderBy("u", key))).where(F.col("_r") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        return pd.DataFrame(_grow(int(pdf.tree.iloc[0]), np.stack(pdf.x.to_numpy()), seed), columns=["tree", "node", "feature", "cut", "left", "right", "size"])

    return dealt.groupBy("tree").applyInPandas(grow, "tree long, node int, feature int, cut double, left int, right int, size int")


def isolation_scores(df: DataFrame, array: str, nodes: DataFrame, out: str = "anomaly_score") -> DataFrame:
    """Scores in (0, 1), higher is more anomalous. The forest (trees x 2 x sample nodes at most) goes to every task."""
    model = nodes.orderBy("tree", "node").toPandas()
    forest = [(g.feature.to_numpy(), g.cut.to_numpy(), g.left.to_numpy(), g.right.to_numpy(), g["size"].to_numpy()) for _, g in model.groupby("tree")]
    scale = float(np.mean([_mean_path(t[4][0]) for t in forest]))
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def rate(batch: pd.Series) -> pd.Series:
        x = np.stack(batch.to_numpy())
        total = np.zeros(len(x))
        for feature, cut, left, right, size in shared.value:
            at, depth = np.zeros(len(x), int), np.zeros(len(x))
            live = feature[at] >= 0
            while live.any():
                i = np.flatnonzero(live)
                f = feature[at[i]]
                at[i] = np.where(x[i, f] < cut[at[i]], left[at[i]], right[at[i]])
                depth[i] += 1
                live = feature[at] >= 0
            total += depth + _mean_path(size[at])
        return pd.Series(2.0 ** (-total / len(shared.value) / max(scale, 1e-9)))

    return df.withColumn(out, rate(F.col(array).cast("array<double>")))


def flag_anomalies(scored: DataFrame, contamination: float = 0.02, score: str = "anomaly_score") -> DataFrame:
    cut = exact_quantiles(scored, [], score, {"c": 1 - contamination}).scalar()
    return scored.withColumn("_c", cut).withColumn("is_anomaly", F.col(score) > F.col("_c")).drop("_c")


def score_summary(scored: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Minimum, p1, p5, median, maximum; written as negative scores, lowest most anomalous."""
    neg = scored.select((-F.col(score)).alias("s"))
    return exact_quantiles(neg, [], "s", {"min": 0.0, "p1": 0.01, "p5": 0.05, "median": 0.5, "max": 1.0}).unpivot([], ["min", "p1", "p5", "median", "max"], "statistic", "score")


# ---------------------------------------------------------------- nearest neighbours


TILE = 2048  # rows on either side of a matrix product


def _attach_pivots(df: DataFrame, pivots: Column) -> DataFrame:
    return df.withColumn("_d", F.transform(pivots, lambda p: F.sqrt(sq_distance(F.col("_x").cast("array<double>"), p))))


def _closest(x: np.ndarray, y: np.ndarray, qi: np.ndarray, mi: np.ndarray, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of x, row of y and exact distance of the k rows of y next to each row of x, ties by id; no row that isn't a finite way off.

    A matrix product gives squares of distances up to rounding. The k-th among the first rows of y bounds the others, and what
    is within the bound and twice the rounding is measured by its differences.
    """
    rows, cols, dist = [], [], []
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    odd = ~np.isfinite(yy)  # their products say nothing
    right = np.c_[y, yy, np.ones(len(y))]
    right[odd] = 0
    slack = 8 * (x.shape[1] + 2) * np.finfo(float).eps
    most = yy[~odd].max(initial=0.0)
    order = np.argsort(mi, kind="stable")
    low, high = (np.searchsorted(mi[order], qi, side=s) for s in ("left", "right"))
    for at in range(0, len(x), TILE):
        mine = slice(at, min(at + TILE, len(x)))
        fine = np.isfinite(xx[mine])
        left = np.c_[-2 * x[mine], np.ones(len(fine)), xx[mine]]
        left[~fine] = 0  # all of y is measured
        own = np.repeat(np.arange(len(fine)), (high - low)[mine])  # pairs of one id
        same = order[np.concatenate([np.arange(0), *[np.arange(u, v) for u, v in zip(low[mine], high[mine]) if v > u]])] if exclude_self else None
        bound, near, other = np.full(len(fine), np.inf), [], []
        for to in range(0, len(y), TILE):
            square = left @ right[to : to + TILE].T
            square[:, odd[to : to + TILE]] = np.inf
            if exclude_self:
                here = (same >= to) & (same < to + TILE)
                square[own[here], same[here] - to] = np.inf
            if not to and square.shape[1] >= k:
                bound = np.partition(square[:, : max(k, TILE // 2)], k - 1, axis=1)[:, k - 1] + 2 * slack * (xx[mine] + most)
                bound[~fine] = np.inf
            hit = square <= bound[:, None]
            if odd.any():
                hit |= odd[to : to + TILE]
            if exclude_self:
                hit[own[here], same[here] - to] = False
            r, c = np.divmod(np.flatnonzero(hit), hit.shape[1])
            near.append(r), other.append(c + to)
            if sum(map(len, near)) > TILE * TILE or to + TILE >= len(y):
                r, c = np.concatenate(near), np.concatenate(other)
                d = np.concatenate([np.zeros(0), *[np.sqrt(((x[at + r[u : u + 100_000]] - y[c[u : u + 100_000]]) ** 2).sum(axis=1)) for u in range(0, len(r), 100_000)]])
                r, c, d = r[np.isfinite(d)], c[np.isfinite(d)], d[np.isfinite(d)]
                by = np.lexsort((mi[c], d, r))
                r, c, d = r[by], c[by], d[by]
                best = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, c, d = r[best], c[best], d[best]
                near, other = [r], [c]
        rows.append(at + r), cols.append(c), dist.append(d)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def nearest_neighbours(train: DataFrame, queries: DataFrame, key: str, array: str, k: int, pivots: int = 16, block: int = 16384, exclude_self: bool = True, seed: int = 42) -> DataFrame:
    """The exact k nearest train rows of every query row: (query, neighbour, distance).

    Train rows belong to the cell of their nearest pivot. A query visits a cell only if the triangle
    inequality allows a closer row there than the k-th distance its cells guarantee. Inside a cell,
    blocks of at most about ``block`` rows on each side are compared by matrix products, tile by tile, and only k
    rows per query leave a block.
    """
    import pyarrow as pa

    # floats travel as they are and are widened where they are measured
    vec = F.col(array) if train.schema[array].dataType.simpleString() == queries.schema[array].dataType.simpleString() == "array<float>" else F.col(array).cast("array<double>")
    t0, q0 = train.select(F.col(key).alias("_id"), vec.alias("_x")), queries.select(F.col(key).alias("_id"), vec.alias("_x"))
    sample = t0.withColumn("_u", hash_uniform("pivots", "_id", seed)).orderBy("_u", "_id").limit(pivots)
    centres = [list(r["_x"]) for r in sample.collect()]
    piv = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    near = F.array_position("_d", F.array_min("_d")).cast("int") - 1
    t = cut_lineage(_attach_pivots(t0, piv).select("_id", "_x", near.alias("cell"), F.array_min("_d").alias("_r")))
    cells = t.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("_r").alias("radius")).collect()  # at most one row per pivot
    parts = {c["cell"]: -(-c["n"] // block) for c in cells}
    lit_cells = F.array(*[F.struct(F.lit(c["cell"]).alias("cell"), F.lit(c["n"]).alias("n"), F.lit(float(c["radius"])).alias("radius"), F.lit(parts[c["cell"]]).alias("parts")) for c in cells])
    q = _attach_pivots(q0, piv)
    reach = F.array_sort(F.transform(lit_cells, lambda c: F.struct((F.element_at("_d", c["cell"] + 1) + c["radius"]).alias("far"), c["n"].alias("n"))))
    need = k + (1 if exclude_self else 0)
    bound = F.aggregate(
        reach, F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("far")),
        lambda s, c: F.when(s["seen"] >= need, s).otherwise(F.struct((s["seen"] + c["n"]).alias("seen"), c["far"].alias("far"))))["far"]
    q = q.withColumn("_t", bound)
    visits = F.filter(lit_cells, lambda c: F.element_at("_d", c["cell"] + 1) - c["radius"] <= F.col("_t") + 1e-9)
    nq = max(1, -(-queries.count() // block))
    q = q.withColumn("qb", F.pmod(F.xxhash64("_id"), F.lit(nq)).cast("int")).withColumn("_c", F.explode(visits))
    q = q.select("_id", "_x", "qb", F.col("_c.cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("_c.parts") - 1)).alias("mb"))
    parts_of = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
    m = t.withColumn("mb", F.pmod(F.xxhash64("_id"), F.element_at(parts_of, F.col("cell"))).cast("int"))
    m = m.select("_id", "_x", "cell", "mb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
    keys = ["cell", "mb", "qb"]
    id_type = q.schema["_id"].dataType.simpleString()

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        qi, mi = np.asarray(a["_id"]), np.asarray(b["_id"])
        kind = a.schema.field("_id").type
        if not len(qi) or not len(mi):
            return pa.table({"query": pa.array([], kind), "neighbour": pa.array([], kind), "distance": pa.array([], pa.float64())})
        x, y = (np.asarray(t["_x"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1) for t in (a, b))
        i, j, d = _closest(x, y, qi, mi, k, exclude_self)
        return pa.table({"query": pa.array(qi[i], kind), "neighbour": pa.array(mi[j], kind), "distance": pa.array(d, pa.float64())})

    found = q.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInArrow(compare, f"query {id_type}, neighbour {id_type}, distance double")
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_predict(neighbours: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Distance-weighted vote over the neighbours; ties go to the smaller label."""
    votes = neighbours.join(labels.select(F.col(key).alias("neighbour"), F.col(label).alias("_l")), "neighbour")
    weight = 1 / F.greatest("distance", F.lit(1e-12))
    per = votes.groupBy("query", "_l").agg(F.sum(weight).alias("_w"))
    return per.groupBy("query").agg(F.max_by("_l", F.struct("_w", -F.col("_l"))).alias("predicted"), F.max("_w").alias("support"))


# ---------------------------------------------------------------- density clusters


def _planar_cells(x: str, y: str, side: float) -> tuple[Column, Column]:
    return F.floor(F.col(x) / side).cast("long"), F.floor(F.col(y) / side).cast("long")


HELD = 64  # points of a box that are looked at one by one; larger ones are split in four


def _boxes(spots: DataFrame, side: float, level: int) -> DataFrame:
    """The points of a cell's quarters, sixteenths and so on: their bounding box, number and weight."""
    sub = [F.floor(F.col(c) / (side / 2**level)).cast("long").alias(k) for c, k in (("px", "sx"), ("py", "sy"))]
    return spots.select("*", *sub).groupBy("cx", "cy", "sx", "sy").agg(
        F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"), F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


def _reach(ax0, ax1, ay0, ay1, bx0, bx1, by0, by1) -> tuple[Column, Column]:
    """Squares of the least and the largest distance between points of two boxes."""
    zero = F.lit(0.0)
    dx, dy = F.greatest(bx0 - ax1, ax0 - bx1, zero), F.greatest(by0 - ay1, ay0 - by1, zero)
    wx, wy = F.greatest(bx1 - ax0, ax1 - bx0), F.greatest(by1 - ay0, ay1 - by0)
    return dx * dx + dy * dy, wx * wx + wy * wy


def _weight_within(probes: DataFrame, spots: DataFrame, eps: float, side: float) -> DataFrame:
    """Weight of the ``spots`` of cell (nx, ny) at most ``eps`` from a probe, where there is any: (px, py, nx, ny, w).

    A box of points that lies inside the circle counts as a whole, one outside not at all; of those the circle cuts, boxes of
    at most ``HELD`` points are looked at point by point and larger ones split, so no key meets more rows than that.
    """
    c = F.col
    left = probes.select("px", "py", "nx", "ny", c("nx").alias("cx"), c("ny").alias("cy"))
    parts, level, on = [], 0, ["cx", "cy"]
    while True:
        boxes = _boxes(spots, side, level)
        boxes = boxes.withColumns({"ux": F.floor(c("sx") / 2).cast("long"), "uy": F.floor(c("sy") / 2).cast("long")}) if level else boxes
        low, high = _reach(c("px"), c("px"), c("py"), c("py"), c("x0"), c("x1"), c("y0"), c("y1"))
        met = left.join(boxes, on).withColumns({"_low": low, "_high": high}).where(c("_low") <= eps * eps)
        met = cut_lineage(met.select("px", "py", "nx", "ny", "cx", "cy", "sx", "sy", "n", "w", "_high"))
        parts.append(met.where(c("_high") <= eps * eps).select("px", "py", "nx", "ny", "w"))
        cut = met.where(c("_high") > eps * eps)
        sub = spots.select(c("px").alias("qx"), c("py").alias("qy"), c("w"), "cx", "cy", *[F.floor(c(x) / (side / 2**level)).cast("long").alias(k) for x, k in (("px", "sx"), ("py", "sy"))])
        close = (c("px") - c("qx")) * (c("px") - c("qx")) + (c("py") - c("qy")) * (c("py") - c("qy")) <= eps * eps
        parts.append(cut.where(c("n") <= HELD).drop("w").join(sub, ["cx", "cy", "sx", "sy"]).where(close).select("px", "py", "nx", "ny", "w"))
        heavy = cut.where(c("n") > HELD)
        if heavy.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), parts).groupBy("px", "py", "nx", "ny").agg(F.sum("w").alias("w"))
        left, level, on = heavy.select("px", "py", "nx", "ny", "cx", "cy", c("sx").alias("ux"), c("sy").alias("uy")), level + 1, ["cx", "cy", "ux", "uy"]


def _close_cells(cores: DataFrame, ahead: Column, eps: float, side: float) -> DataFrame:
    """Pairs of cells (cx, cy) and (nx, ny), one of the ``ahead`` steps apart, that hold two points at most ``eps`` apart.

    Boxes surely close link their cells at once, boxes surely apart are dropped, pairs of boxes of few points are compared, and
    the rest is split. Cells that are linked leave, so dense ones are rarely looked into.
    """
    c = F.col
    spots = cores.withColumn("w", F.lit(1))
    cells = _boxes(spots, side, 0).select("cx", "cy")
    left = cells.select("cx", "cy", ahead).select("cx", "cy", (c("cx") + c("o.i")).alias("nx"), (c("cy") + c("o.j")).alias("ny"))
    parts, level = [], 0
    on_a, on_b = ["cx", "cy"], ["nx", "ny"]
    while True:
        boxes = _boxes(spots, side, level)
        if level:
            boxes = boxes.withColumns({"ux": F.floor(c("sx") / 2).cast("long"), "uy": F.floor(c("sy") / 2).cast("long")})
        named = lambda x, cell: boxes.select(*[c(k).alias(v) for k, v in zip(("cx", "cy"), cell)], *[c(k).alias(f"{x}{k}") for k in boxes.columns if k not in ("cx", "cy", "w")])
        low, high = _reach(*[c(f"a{k}") for k in ("x0", "x1", "y0", "y1")], *[c(f"b{k}") for k in ("x0", "x1", "y0", "y1")])
        met = left.join(named("a", ("cx", "cy")), on_a).join(named("b", ("nx", "ny")), on_b).withColumns({"_low": low, "_high": high}).where(c("_low") <= eps * eps)
        met = cut_lineage(met.select("cx", "cy", "nx", "ny", "asx", "asy", "bsx", "bsy", "an", "bn", "_high"))
        sure = met.where(c("_high") <= eps * eps).select("cx", "cy", "nx", "ny")
        cut = met.where(c("_high") > eps * eps)
        few = c("an") * c("bn") <= HELD * HELD
        sub = lambda x, q, cell: cores.select(c("px").alias(f"{q}x"), c("py").alias(f"{q}y"), *[c(k).alias(v) for k, v in zip(("cx", "cy"), cell)], *[F.floor(c(p) / (side / 2**level)).cast("long").alias(f"{x}{k}") for p, k in (("px", "sx"), ("py", "sy"))])
        close = (c("px") - c("qx")) * (c("px") - c("qx")) + (c("py") - c("qy")) * (c("py") - c("qy")) <= eps * eps
        points = cut.where(few).join(sub("a", "p", ("cx", "cy")), ["cx", "cy", "asx", "asy"]).join(sub("b", "q", ("nx", "ny")), ["nx", "ny", "bsx", "bsy"]).where(close).select("cx", "cy", "nx", "ny")
        found = cut_lineage(sure.unionByName(points).distinct())
        parts.append(found)
        heavy = cut.where(~few).join(found, ["cx", "cy", "nx", "ny"], "left_anti")
        if heavy.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), parts)
        left, level = heavy.select("cx", "cy", "nx", "ny", c("asx").alias("aux"), c("asy").alias("auy"), c("bsx").alias("bux"), c("bsy").alias("buy")), level + 1
        on_a, on_b = ["cx", "cy", "aux", "auy"], ["nx", "ny", "bux", "buy"]


def _around() -> tuple[list[tuple[int, int]], Column]:
    """The 21 cells that hold points within eps of a cell, as steps, and a column that lists them."""
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4]
    return steps, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("o")


def _core_spots(df: DataFrame, x: str, y: str, eps: float, min_points: int) -> tuple[DataFrame, DataFrame]:
    """Distinct points with cell and weights, and those with ``min_points`` within eps: (px, py, cx, cy).

    Identical points are merged with their weight first. Cells have side eps / sqrt(2), so all points of a
    cell are neighbours: a cell of enough weight is core without looking at pairs. Only the points of
    lighter cells count neighbours one by one, in the 21 cells around.
    """
    side = eps / math.sqrt(2)
    spots = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("px"), F.col(y).alias("py")).agg(F.count(F.lit(1)).alias("w"))
    spots = cut_lineage(spots.withColumns({"cx": _planar_cells("px", "py", side)[0], "cy": _planar_cells("px", "py", side)[1]}))
    heavy = spots.groupBy("cx", "cy").agg(F.sum("w").alias("cw"))
    tagged = spots.join(heavy, ["cx", "cy"])
    light = tagged.where(F.col("cw") < min_points)
    probe = light.select("px", "py", "cx", "cy", _around()[1]).select("px", "py", (F.col("cx") + F.col("o.i")).alias("nx"), (F.col("cy") + F.col("o.j")).alias("ny"))
    dense = _weight_within(probe, spots.select("px", "py", "cx", "cy", "w"), eps, side).groupBy("px", "py").agg(F.sum("w").alias("nb")).where(F.col("nb") >= min_points)
    return tagged, cut_lineage(tagged.where(F.col("cw") >= min_points).select("px", "py", "cx", "cy").unionByName(light.join(dense, ["px", "py"]).select("px", "py", "cx", "cy")))


def core_points(df: DataFrame, key: str, x: str, y: str, eps: float, min_points: int) -> DataFrame:
    """(key, is_core) as ``dbscan`` gives them, without linking cells to clusters."""
    cores = _core_spots(df, x, y, eps, min_points)[1].select("px", "py", F.lit(True).alias("_core"))
    return df.join(cores, (df[x] == cores["px"]) & (df[y] == cores["py"]), "left").select(df[key], F.coalesce("_core", F.lit(False)).alias("is_core"))


def dbscan(df: DataFrame, key: str, x: str, y: str, eps: float, min_points: int) -> DataFrame:
    """Density clusters of points in the plane: (key, is_core, cluster), noise is -1, exact.

    Cells with core points are linked when a core pair is close enough, and labels flow over the cell graph
    until nothing changes.
    """
    side = eps / math.sqrt(2)
    tagged, cores = _core_spots(df, x, y, eps, min_points)
    steps, around = _around()
    name = lambda p, q: F.concat_ws(":", p, q)
    ahead = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps if (i, j) > (0, 0)])).alias("o")
    links = _close_cells(cores, ahead, eps, side).select(name("cx", "cy").alias("s"), name("nx", "ny").alias("t"))
    both = cut_lineage(links.unionByName(links.select(F.col("t").alias("s"), F.col("s").alias("t"))))
    labels = cut_lineage(cores.select(name("cx", "cy").alias("cell")).distinct().withColumn("label", F.col("cell")))
    while True:  # labels only fall, so this ends
        near = both.join(labels, both["s"] == labels["cell"]).groupBy(F.col("t").alias("cell")).agg(F.min("label").alias("_l"))
        step = labels.join(near, "cell", "left").select("cell", F.least("label", F.coalesce("_l", "label")).alias("_m"))
        # jump: take the label of the label's own cell, which shortens long chains
        hop = step.select(F.col("cell").alias("_c"), F.col("_m").alias("_h"))
        new = cut_lineage(step.join(hop, step["_m"] == hop["_c"], "left").select("cell", F.least("_m", F.coalesce("_h", "_m")).alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "_old"), "cell").where("label <> _old").limit(1).count()
        labels = new
        if not changed:
            break
    core_label = cores.select("px", "py", name("cx", "cy").alias("cell"), F.lit(True).alias("_core")).join(labels, "cell").select("px", "py", "_core", "label")
    # border points take the smallest cluster among close core points
    rim = tagged.join(cores.select("px", "py"), ["px", "py"], "left_anti")
    r = rim.select("px", "py", "cx", "cy", around).select("px", "py", (F.col("cx") + F.col("o.i")).alias("nx"), (F.col("cy") + F.col("o.j")).alias("ny"))
    # the core points of a cell are one cluster, so it is enough to know which cells have one nearby
    met = _weight_within(r, cores.withColumn("w", F.lit(1).cast("long")), eps, side).select("px", "py", name("nx", "ny").alias("cell"))
    border = met.join(labels, "cell").groupBy("px", "py").agg(F.min("label").alias("label")).select("px", "py", F.lit(False).alias("_core"), "label")
    known = core_label.unionByName(border)
    ids = labels.select("label").distinct()
    from .ordered import numbered, text_ranges

    ranged, bucket = text_ranges(ids, "label")
    numbers = numbered(ranged, [], ["label"], bucket, pos="cluster")
    named = known.join(numbers, "label").select("px", "py", "_core", "cluster")
    return df.join(named, (df[x] == named["px"]) & (df[y] == named["py"]), "left").select(
        df[key], F.coalesce("_core", F.lit(False)).alias("is_core"), F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def dbscan_summary(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"), F.avg((F.col("cluster") < 0).cast("int")).alias("noise_share"))
