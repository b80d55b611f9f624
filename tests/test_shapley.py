"""Exact tree attributions against all subsets of features, on the model's own nodes."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from fleetspan.operators import explain as EX
from fleetspan.operators import models as MO
from fleetspan.operators.tree_shapley import tree_shapley

NAMES = ["load_kg", "km", "delay", "priority"]


@pytest.fixture(scope="module")
def prepared(spark):
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(900, 3)), rng.integers(0, 5, 900)
    y = ((x[:, 0] > 0) & (c % 2 == 0) | (x[:, 1] + x[:, 2] > 1)).astype(float)
    rows = [(i, *map(float, r), str(k), float(v), "val" if i % 7 == 0 else "train", 1.0 + i % 3) for i, (r, k, v) in enumerate(zip(x, c, y))]
    df = spark.createDataFrame(rows, "row_id long, load_kg double, km double, delay double, p string, label double, split string, weight double")
    return Pipeline(stages=[StringIndexer(inputCol="p", outputCol="priority"), VectorAssembler(inputCols=NAMES, outputCol="features")]).fit(df).transform(df).persist()


def worth(nodes, value, subset, x, i=0):
    """The score expected of one tree if only the features of ``subset`` are known."""
    n = nodes[i]
    if n["leftChild"] < 0:
        return value(n)
    f, at = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"]
    if f in subset:
        left = x[f] <= at[0] if n["split"]["numCategories"] < 0 else x[f] in at
        return worth(nodes, value, subset, x, n["leftChild"] if left else n["rightChild"])
    return sum(nodes[k]["rawCount"] / n["rawCount"] * worth(nodes, value, subset, x, k) for k in (n["leftChild"], n["rightChild"]))


@pytest.mark.parametrize("kind, name, params", [
    ("binary", "random_forest", {"numTrees": 5, "maxDepth": 5}), ("binary", "decision_tree", {"maxDepth": 6}),
    ("regression", "gradient_boosting", {"maxIter": 4, "maxDepth": 3}), ("binary", "gradient_boosting", {"maxIter": 4, "maxDepth": 3}),
])
def test_values_are_those_of_all_subsets(spark, prepared, tmp_path, kind, name, params):
    fitted = MO.fit_model(name, prepared, kind, params)
    rows = EX.feature_rows(prepared, "row_id", "label").where("row_id % 9 = 0")
    out = tree_shapley(rows, fitted, NAMES).toPandas()
    assert len(out) == 4 * rows.count()
    sums = out.groupby("row_id").agg(s=("shap", "sum"), score=("score", "first"), base=("base", "first"))
    assert np.allclose(sums.s, sums.score - sums.base, atol=1e-12)
    told = MO.score(fitted, prepared).select("row_id", "prediction", *(["p"] if kind == "binary" else [])).toPandas().set_index("row_id").loc[sums.index]
    score = told.prediction if kind == "regression" else told.p if name != "gradient_boosting" else -np.log(1 / told.p - 1) / 2
    assert np.allclose(sums.score, score, atol=1e-9)

    fitted.model.write().save(str(tmp_path / "m"))
    data = spark.read.parquet(str(tmp_path / "m" / "data"))
    data = data.select("treeID", "nodeData.*") if "nodeData" in data.columns else data.withColumn("treeID", F.lit(0))
    trees = {}
    for r in data.collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    weights = {0: 1.0} if name == "decision_tree" else {t: 1 / len(trees) if name == "random_forest" else w for t, w in enumerate(fitted.model.treeWeights)}
    value = (lambda n: n["impurityStats"][1] / sum(n["impurityStats"])) if kind == "binary" and name != "gradient_boosting" else (lambda n: n["prediction"])
    for r in rows.orderBy("row_id").limit(4).collect():
        game = {s: sum(weights[t] * worth(n, value, s, r["x"]) for t, n in trees.items()) for k in range(5) for s in combinations(range(4), k)}
        mine = out[out.row_id == r["row_id"]].set_index("feature")
        for f, label in enumerate(NAMES):
            others = [s for s in game if f not in s]
            want = sum(factorial(len(s)) * factorial(3 - len(s)) / 24 * (game[tuple(sorted((*s, f)))] - game[s]) for s in others)
            assert mine.shap[label] == pytest.approx(want, abs=1e-12) and mine.feature_value[label] == r["x"][f]


def test_no_rows_and_missing_values(spark, prepared):
    fitted = MO.fit_model("decision_tree", prepared, "binary", {"maxDepth": 3})
    rows = EX.feature_rows(prepared, "row_id", "label")
    assert tree_shapley(rows.limit(0), fitted, NAMES).count() == 0
    odd = spark.createDataFrame([(1, [float("nan")] * 4), (2, [1e9, -1e9, 0.0, 99.0])], "row_id long, x array<double>")
    out = tree_shapley(odd, fitted, NAMES).groupBy("row_id").agg(F.sum("shap").alias("s"), F.first("score").alias("p"), F.first("base").alias("b")).collect()
    assert len(out) == 2 and all(abs(r["s"] - r["p"] + r["b"]) < 1e-12 for r in out)
