"""Model metrics as aggregates over scored rows.

Curves and rank metrics first collapse rows to distinct scores, so ties are handled exactly and the
cumulative steps run on the smaller table, in score buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered
from .profile import one_row
from .quantiles import exact_quantiles

SCORE_BUCKETS = 1000


def _score_bucket(score: str) -> Column:
    """Descending buckets of a probability; other scores need their own bucket."""
    return -F.floor(F.col(score) * SCORE_BUCKETS)


def score_table(df: DataFrame, label: str, score: str, bucket: Column | None = None) -> DataFrame:
    """Distinct scores, highest first, with the positives and negatives at and above each."""
    d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    b = bucket if bucket is not None else _score_bucket("score")
    return numbered(d, [], [F.col("score").desc()], b, pos=None, running={"pos_above": "pos", "neg_above": "neg"})


def totals(st: DataFrame) -> Column:
    return one_row(st.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Probability that a positive outscores a negative, ties counting one half."""
    st = score_table(df, label, score)
    wins = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2))
    return st.agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum over distinct scores, highest first, of recall step times precision."""
    st = score_table(df, label, score)
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    return st.agg(F.try_divide(F.sum(F.col("pos") * tp / (tp + fp)), F.sum("pos")).alias("average_precision"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    st = score_table(df, label, score)
    return st.withColumn("_t", totals(st)).select(
        F.col("score").alias("threshold"), F.try_divide(F.col("neg_above") + F.col("neg"), F.col("_t.n")).alias("fpr"),
        F.try_divide(F.col("pos_above") + F.col("pos"), F.col("_t.p")).alias("tpr"))


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    st = score_table(df, label, score)
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    return st.withColumn("_t", totals(st)).select(
        F.col("score").alias("threshold"), (tp / (tp + fp)).alias("precision"), F.try_divide(tp, F.col("_t.p")).alias("recall"))


def confusion_long(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_table(df: DataFrame, label: str, pred: str, classes: Sequence) -> DataFrame:
    """Actual x predicted counts with one column per class."""
    return df.groupBy(F.col(label).alias("actual")).agg(*[F.count_if(F.col(pred) == c).alias(f"pred_{c}") for c in classes])


def per_class(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Support, precision, recall and F1 per class, from the confusion counts."""
    cm = confusion_long(df, label, pred)
    classes = cm.select(F.explode(F.array("actual", "predicted")).alias("class")).distinct()
    rows = cm.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    cols = cm.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted"))
    both = classes.join(rows, "class", "left").join(cols, "class", "left").fillna(0, ["support", "tp", "predicted"])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    return both.withColumns({"precision": prec, "recall": rec}).withColumn(
        "f1", F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("predicted") + F.col("support")), F.lit(0.0)))


def classification_metrics(df: DataFrame, label: str, pred: str, score: str | None = None) -> DataFrame:
    """One row of binary metrics; label and prediction are 0 or 1."""
    y, p = F.col(label), F.col(pred)
    cells = [F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y != 1) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p != 1)).alias("fn"), F.count_if((y != 1) & (p != 1)).alias("tn")]
    extra = []
    if score:
        s, yy = F.col(score), (y == 1).cast("double")
        q = F.greatest(F.least(s, F.lit(1 - 1e-7)), F.lit(1e-7))
        extra = [F.avg((s - yy) * (s - yy)).alias("brier"), F.avg(-(yy * F.log(q) + (1 - yy) * F.log(1 - q))).alias("log_loss")]
    out = df.agg(*cells, *extra)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f1, f1n = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    out = out.withColumns({
        "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn), "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2,
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f1, "f1_macro": (f1 + f1n) / 2, "mcc": ratio(tp * tn - fp * fn, spread),
    })
    if score:
        out = out.withColumns({"roc_auc": roc_auc(df, label, score).scalar(), "average_precision": average_precision(df, label, score).scalar()})
    return out


def multiclass_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Accuracy and macro averages over all classes that occur."""
    pc = per_class(df, label, pred)
    return pc.agg(
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1_macro"))


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """RMSE, MAE, median and maximum error, R2, explained variance, MAPE away from zero."""
    d = df.where(F.col(label).isNotNull() & F.col(pred).isNotNull()).select(F.col(label).cast("double").alias("y"), F.col(pred).cast("double").alias("p"))
    e = F.col("y") - F.col("p")
    med = exact_quantiles(d.select(F.abs(e).alias("a")), [], "a", {"m": 0.5}).scalar()
    return d.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("max_error"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop("y"))).alias("r2"), (1 - F.try_divide(F.var_pop(e), F.var_pop("y"))).alias("explained_variance"),
        (F.avg(F.when(F.abs("y") > 1e-6, F.abs(e / F.col("y")))) * 100).alias("mape"),
    ).withColumn("median_ae", med)


def calibration_table(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Rows, mean prediction, observed rate and gap per probability bin; empty bins are absent."""
    slot = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    g = df.where(F.col(score).isNotNull()).groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_predicted"), F.avg((F.col(label) == 1).cast("int")).alias("observed_rate"))
    return g.withColumn("gap", F.col("mean_predicted") - F.col("observed_rate"))


def residual_table(df: DataFrame, label: str, pred: str, by: str) -> DataFrame:
    """Mean residual and spread along a grouping of the rows."""
    e = F.col(label) - F.col(pred)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean_residual"), F.stddev_samp(e).alias("residual_std"))
