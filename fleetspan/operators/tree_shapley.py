"""Exact Shapley values of tree models, for every row, from the paths to the leaves.

A feature set S is worth the score expected when splits on features in S are followed and all others are taken in
proportion to the training rows on either side. That game is a sum over leaves: a leaf with value v, whose path tests the
features j = 1..d, contributes v times the product over j of o_j (does the row pass all tests on j) for j in S and of z_j
(the share of training rows that pass) else. Feature i's value in such a product game is

    v (o_i - z_i) times the integral over t in (0, 1) of the product over the other j of z_j (1 - t) + o_j t,

as the Shapley weights k! (d - 1 - k)! / d! are the integrals of t^k (1 - t)^(d - 1 - k). The integrand is a polynomial of
degree d - 1, so Gauss-Legendre points give the integral exactly. All leaves of a tree are worked at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .models import Fitted

CELLS = 1_000_000  # rows x leaves x path features x points worked at once


@dataclass
class Paths:
    """The leaves of one tree as arrays of (leaf, slot), a slot being one feature that the path tests; unused slots pass always."""

    value: np.ndarray  # by leaf, with the tree's weight
    share: np.ndarray  # by leaf, of training rows
    feature: np.ndarray
    low: np.ndarray  # passes if low < x <= high
    high: np.ndarray
    passed: np.ndarray  # z: the share of rows that pass the feature's tests
    allowed: np.ndarray | None  # by (leaf, slot, category) where the tree has categorical splits
    points: np.ndarray
    weights: np.ndarray


def read_trees(fitted: Fitted, spark: SparkSession) -> list[Paths]:
    """The leaves of a fitted tree, forest or boosted model; their number is fixed by the model's parameters.

    A leaf is worth the share of the last class, or the prediction of a regression tree. A boosted classifier adds up
    margins, so its values explain the margin.
    """
    path = shared_folder(spark, "trees")
    fitted.model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
        tree_weights = [float(w) for w in fitted.model.treeWeights]
        if "RandomForest" in type(fitted.model).__name__:
            tree_weights = [1.0 / len(tree_weights)] * len(tree_weights)
    else:
        nodes, tree_weights = nodes.withColumn("treeID", F.lit(0)), [1.0]
    classes = getattr(fitted.model, "numClasses", 0) if "GBT" not in type(fitted.model).__name__ else 0
    trees: dict[int, dict[int, object]] = {}
    for r in nodes.collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    return [_paths(trees[t], w, classes) for t, w in enumerate(tree_weights)]


def _paths(nodes: dict, weight: float, classes: int) -> Paths:
    leaves: list[tuple[float, float, dict]] = []
    arity = max([n["split"]["numCategories"] for n in nodes.values()] + [0])

    def walk(i: int, tests: dict) -> None:
        n = nodes[i]
        if n["leftChild"] < 0:
            value = n["impurityStats"][-1] / sum(n["impurityStats"]) if classes else n["prediction"]
            leaves.append((weight * value, n["rawCount"] / nodes[0]["rawCount"], tests))
            return
        f, at = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"]
        for child, left in ((n["leftChild"], True), (n["rightChild"], False)):
            low, high, allowed, z = tests.get(f, (-np.inf, np.inf, None, 1.0))
            z = z * nodes[child]["rawCount"] / n["rawCount"]
            if n["split"]["numCategories"] < 0:
                low, high = (low, min(high, at[0])) if left else (max(low, at[0]), high)
            else:
                here = np.isin(np.arange(arity), np.asarray(at, int)) == left
                allowed = here if allowed is None else allowed & here
            walk(child, {**tests, f: (low, high, allowed, z)})

    walk(0, {})
    depth = max(1, max(len(t) for _, _, t in leaves))
    shape = (len(leaves), depth)
    feature, low, high, passed = np.zeros(shape, int), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape)
    table = np.ones((*shape, arity), bool) if arity else None
    for k, (_, _, tests) in enumerate(leaves):
        for s, (f, (lo, hi, allowed, z)) in enumerate(tests.items()):
            feature[k, s], low[k, s], high[k, s], passed[k, s] = f, lo, hi, z
            if allowed is not None:
                table[k, s] = allowed
    points, weights = np.polynomial.legendre.leggauss(-(-depth // 2))
    return Paths(np.array([v for v, _, _ in leaves]), np.array([s for _, s, _ in leaves]), feature, low, high, passed, table, (points + 1) / 2, weights / 2)


def shapley_values(x: np.ndarray, trees: Sequence[Paths]) -> tuple[np.ndarray, np.ndarray]:
    """Values by (row, feature) and the score of each row."""
    x = np.where(np.isnan(x), np.inf, x)  # a missing value fails every threshold
    out, score = np.zeros(x.shape), np.zeros(len(x))
    for t in trees:
        leaves, depth = t.feature.shape
        place = np.zeros((leaves * depth, x.shape[1]))
        place[np.arange(leaves * depth), t.feature.ravel()] = 1.0
        step = max(1, CELLS // (leaves * depth * len(t.points)))
        for a in range(0, len(x), step):
            v = x[a : a + step][:, t.feature]
            passes = (v > t.low) & (v <= t.high) | (t.low == -np.inf) & (t.high == np.inf)
            if t.allowed is not None:
                code = np.clip(np.where(np.isfinite(v), v, 0), 0, t.allowed.shape[2] - 1).astype(int)
                passes &= t.allowed[np.arange(leaves)[:, None], np.arange(depth), code]
            o, z = passes.astype(float), t.passed
            score[a : a + step] += passes.all(2) @ t.value
            total = np.zeros(o.shape)
            for p, w in zip(t.points, t.weights):
                factor = z * (1 - p) + o * p
                total += w * factor.prod(2, keepdims=True) / factor
            gain = t.value[:, None] * (o - z) * total
            out[a : a + step] += gain.reshape(len(v), -1) @ place
    return out, score


def base_score(trees: Sequence[Paths]) -> float:
    """The score expected of a row of which nothing is known."""
    return float(sum((t.value * t.share).sum() for t in trees))


def tree_shapley(rows: DataFrame, fitted: Fitted, names: Sequence[str]) -> DataFrame:
    """Exact Shapley values of a tree model for every row of ``rows`` (row_id, x): one row per row and feature.

    Returns row_id, feature, feature_value, shap, score and base; the values of a row add up to score - base. The rows are
    read once and not shuffled; what is broadcast are the model's leaves.
    """
    spark = rows.sparkSession
    trees = read_trees(fitted, spark)
    held = spark.sparkContext.broadcast([t.__dict__ for t in trees])

    @F.arrow_udf("struct<shap: array<double>, score: double>")
    def explained(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mine = [Paths(**t) for t in held.value]
        for batch in batches:
            x = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.empty((0, len(names)))
            values, score = shapley_values(x, mine)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(names), pa.int32()), pa.array(values.ravel()))
            yield pa.StructArray.from_arrays([lists, pa.array(score)], names=["shap", "score"])

    labels = F.array(*[F.lit(n) for n in names])
    told = rows.select("row_id", "x", explained(F.col("x")).alias("e"))
    return told.select("row_id", "x", "e.score", F.posexplode("e.shap").alias("f", "shap")).select(
        "row_id", F.get(labels, F.col("f")).alias("feature"), F.get("x", F.col("f")).alias("feature_value"), "shap", "score", F.lit(base_score(trees)).alias("base"))
