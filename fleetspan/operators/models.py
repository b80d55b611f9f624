"""Supervised models on MLlib: preparation fitted on train only, class weights, calibration, leaderboards.

What MLlib does not offer is said in ``NOTES`` and carried into the leaderboard.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, MinMaxScaler, OneHotEncoder, RobustScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as ME
from .sets import leaderboard

PART_ROWS = 100_000  # rows of prepared features that one task reads at most

SCALERS = {"standard": lambda **k: StandardScaler(withMean=True, **k), "minmax": MinMaxScaler, "robust": RobustScaler}

NOTES = {
    "gradient_boosting": "binary and regression only; several classes go through one-vs-rest",
    "svm": "linear margin; ranked by raw score, no probabilities",
    "mlp": "classification only",
}


# ---------------------------------------------------------------- preparation


def fit_preprocessor(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), scaler: str = "standard", encoding: str = "ordinal", indicators: bool = True) -> PipelineModel:
    """Median fill, missing indicators, scaling; ordinal or one-hot categories. Fitted on ``train`` only.

    The input must already hold doubles. Categories unseen in train get their own last code.
    """
    numeric, stages = list(numeric), []
    flags = []
    if indicators:
        row = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric]).first()
        flags = [c for c in numeric if row[c] > 0]
    filled = [f"{c}__filled" for c in numeric]
    stages.append(Imputer(strategy="median", inputCols=numeric, outputCols=filled, relativeError=0.0001))
    from pyspark.ml.feature import SQLTransformer

    if flags:
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(f"CAST(`{c}` IS NULL AS DOUBLE) AS `{c}__was_missing`" for c in flags) + " FROM __THIS__"))
    stages.append(VectorAssembler(inputCols=filled + [f"{c}__was_missing" for c in flags], outputCol="_num", handleInvalid="keep"))
    parts = ["_num"]
    if scaler != "none":
        stages.append(SCALERS[scaler](inputCol="_num", outputCol="_scaled"))
        parts = ["_scaled"]
    if categorical:
        codes = [f"{c}__code" for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep"))
        if encoding == "onehot":
            hot = [f"{c}__hot" for c in categorical]
            stages.append(OneHotEncoder(inputCols=codes, outputCols=hot, handleInvalid="keep", dropLast=False))
            codes = hot
        parts += codes
    stages.append(VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages).fit(train)


def parts_for(spark, rows: int) -> int:
    """How many parts prepared rows are dealt into: one a shuffle partition, and more as soon as these would outgrow ``PART_ROWS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights n / (k * n_c), one row per class joined back; classes are few, so the rows stay where they are."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("n"), F.count(F.lit(1)).alias("k"))
    table = counts.withColumns({"_n": tot.select("n").scalar(), "_k": tot.select("k").scalar()}).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(table), label)


def split_guard(df: DataFrame, label: str, split: str = "split", rare: int = 10) -> DataFrame:
    """Classes, rarest count and verdict per side: a train side with one class cannot be fitted."""
    per = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("_c")).groupBy(split).agg(F.count(F.lit(1)).alias("classes"), F.min("_c").alias("rarest"))
    verdict = F.when((F.col(split) == "train") & (F.col("classes") < 2), "skip: one class in train").when(F.col("classes") < 2, "warn: ranking metrics undefined").when(F.col("rarest") < rare, "warn: rare class").otherwise("ok")
    return per.withColumn("verdict", verdict)


# ---------------------------------------------------------------- model builders


@dataclass
class Fitted:
    name: str
    model: object
    train_seconds: float
    notes: str = ""
    score: str = "probability"  # or rawPrediction


def _binary(params: Mapping, cls: Callable, **fixed):
    return cls(featuresCol="features", labelCol="label", **{**fixed, **params})


CLASSIFIERS: dict[str, Callable[[Mapping], object]] = {
    "logistic_regression": lambda p: _binary(p, LogisticRegression, weightCol="weight", maxIter=100),
    "decision_tree": lambda p: _binary(p, DecisionTreeClassifier, weightCol="weight", maxDepth=12, minInstancesPerNode=20, seed=42),
    "random_forest": lambda p: _binary(p, RandomForestClassifier, weightCol="weight", numTrees=300, maxDepth=18, minInstancesPerNode=5, seed=42),
    "gradient_boosting": lambda p: _binary(p, GBTClassifier, maxIter=100, maxDepth=5, validationIndicatorCol="is_val", seed=42),
    "svm": lambda p: _binary(p, LinearSVC, weightCol="weight", regParam=0.01, maxIter=100),
    "mlp": lambda p: _binary(p, MultilayerPerceptronClassifier, maxIter=100, seed=42),
}
REGRESSORS: dict[str, Callable[[Mapping], object]] = {
    "linear_regression": lambda p: _binary(p, LinearRegression, maxIter=100),
    "decision_tree": lambda p: _binary(p, DecisionTreeRegressor, maxDepth=12, minInstancesPerNode=20, seed=42),
    "random_forest": lambda p: _binary(p, RandomForestRegressor, numTrees=300, maxDepth=18, minInstancesPerNode=5, seed=42),
    "gradient_boosting": lambda p: _binary(p, GBTRegressor, maxIter=100, maxDepth=5, validationIndicatorCol="is_val", seed=42),
}


def fit_model(name: str, prepared: DataFrame, kind: str, params: Mapping | None = None, classes: int = 2) -> Fitted:
    """Fit on train rows; boosting also sees the validation rows to stop early. ``kind``: binary, multiclass, regression."""
    table = REGRESSORS if kind == "regression" else CLASSIFIERS
    params = dict(params or {})
    if name == "mlp" and "layers" not in params:
        size = prepared.schema["features"].metadata.get("ml_attr", {}).get("num_attrs") or len(prepared.select("features").first()[0])
        params["layers"] = [size, 64, 32, classes]
    est = table[name](params)
    rows = prepared.where("split IN ('train', 'val')").withColumn("is_val", F.col("split") == "val") if name == "gradient_boosting" else prepared.where("split = 'train'")
    if kind == "multiclass" and name in ("gradient_boosting", "svm"):
        inner = est if name == "svm" else GBTClassifier(featuresCol="features", labelCol="label", seed=42, **{k: v for k, v in params.items()})
        est, rows = OneVsRest(classifier=inner, featuresCol="features", labelCol="label"), prepared.where("split = 'train'")
    t0 = time.perf_counter()
    model = est.fit(rows)
    return Fitted(name, model, time.perf_counter() - t0, NOTES.get(name, ""), "rawPrediction" if name == "svm" else "probability")


def score(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Add ``prediction`` and, for classifiers, ``p`` (probability or margin of the last class)."""
    out = fitted.model.transform(df)
    if fitted.score in out.columns:
        out = out.withColumn("p", F.element_at(vector_to_array(fitted.score), -1))
        if fitted.score == "rawPrediction":
            out = out.withColumn("p", 1 / (1 + F.exp(-F.col("p"))))  # ranks as the margin does
    return out


def calibrate(fitted: Fitted, val: DataFrame):
    """Isotonic map from score to observed rate, fitted on validation rows the model has not seen."""
    return IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(score(fitted, val).select("p", "label"))


def apply_calibration(iso, scored: DataFrame) -> DataFrame:
    return iso.transform(scored)


def benchmark(prepared: DataFrame, kind: str, models: Mapping[str, Mapping], primary: str | None = None) -> tuple[DataFrame, list[Fitted]]:
    """Fit each model and rank them by the primary metric on the test side; failures become notes."""
    rows, fitted = None, []
    test = prepared.where("split = 'test'")
    for name, params in models.items():
        try:
            f = fit_model(name, prepared, kind, params)
        except Exception as err:  # one model's failure does not end the comparison
            skipped = prepared.sparkSession.range(1).select(F.lit(name).alias("model"), F.lit(f"failed: {type(err).__name__}: {err}"[:200]).alias("notes"))
            rows = skipped if rows is None else rows.unionByName(skipped, allowMissingColumns=True)
            continue
        fitted.append(f)
        s = score(f, test)
        if kind == "regression":
            m = ME.regression_metrics(s, "label", "prediction")
        elif kind == "binary":
            m = ME.classification_metrics(s, "label", "prediction", "p" if "p" in s.columns else None)
        else:
            m = ME.multiclass_metrics(s, "label", "prediction")
        m = m.select(F.lit(name).alias("model"), "*", F.lit(float(f.train_seconds)).alias("train_seconds"), F.lit(f.notes).alias("notes"))
        rows = m if rows is None else rows.unionByName(m, allowMissingColumns=True)
    metric = primary or {"regression": "rmse", "binary": "roc_auc", "multiclass": "f1_macro"}[kind]
    return leaderboard(rows, metric), fitted


def native_importance(fitted: Fitted, names: Sequence[str], spark) -> DataFrame | None:
    """Tree importances or absolute coefficients, ranked; None where the model has neither."""
    m = fitted.model
    if hasattr(m, "featureImportances"):
        values = m.featureImportances.toArray()
    elif hasattr(m, "coefficients"):
        values = abs(m.coefficients.toArray())
    else:
        return None
    rows = sorted(((n, float(v)) for n, v in zip(names, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(n, v, i + 1) for i, (n, v) in enumerate(rows)], "feature string, importance double, rank int")


# ---------------------------------------------------------------- batch scoring


def contract_frame(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The columns a model was trained on, in order: missing ones are 0 and reported, extras ignored, non-finite values 0."""
    from ..functions.scalars import replace_nonfinite

    missing = [c for c in features if c not in df.columns]
    kept = [F.lit(0.0).alias(c) if c in missing else replace_nonfinite(F.col(c).cast("double")).alias(c) for c in features]
    extra = [c for c in df.columns if c.endswith("_id") or c == "label"]
    return df.select(*extra, *kept), missing


def batch_score(df: DataFrame, path: str, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Score with a saved ``PipelineModel`` under the feature contract: label and class probabilities."""
    ready, missing = contract_frame(df, features)
    out = PipelineModel.load(path).transform(ready)
    cols = [c for c in df.columns if c in ready.columns and c not in features]
    probs = [F.transform(vector_to_array("probability"), lambda x: F.round(x, 6)).alias("probabilities")] if "probability" in out.columns else []
    return out.select(*cols, "prediction", *probs), missing
