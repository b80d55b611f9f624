"""Prediction tasks: label and features with leakage removed."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import has_label
from ..functions.scalars import rate
from .joins import flag_members
from .ordered import lead_label, prefix_sums, rolling_mean_column, windowed
from .physics import LEAKAGE_COLUMNS, drop_columns
from .quantiles import exact_quantiles


@dataclass(frozen=True)
class Task:
    name: str
    kind: str  # binary, multiclass, regression
    target: str
    extra_leakage: Sequence[str] = field(default_factory=tuple)


# The seven tasks that read the feature table directly.
DIRECT_TASKS = {
    t.name: t
    for t in [
        Task("late_delivery", "binary", "target_is_late"),
        Task("late_before_dispatch", "binary", "target_is_late", ("lead_time_hours", "driver_id", "vehicle_id", "route_stops", "stops_ahead")),
        Task("delay_minutes", "regression", "target_delay_minutes"),
        Task("eta_minutes", "regression", "target_eta_minutes"),
        Task("delivery_cost", "regression", "target_delivery_cost"),
        Task("risk_bucket", "multiclass", "target_risk_bucket"),
        Task("route_failure", "binary", "target_will_be_returned"),
    ]
}


def direct_task(features: DataFrame, task: Task, leakage: Sequence[str] = LEAKAGE_COLUMNS, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with a known target; the target becomes ``label``, everything that gives it away goes."""
    known = features.where(F.col(task.target).isNotNull()).withColumn("label", F.col(task.target)).drop(task.target, *task.extra_leakage)
    return drop_columns(known, leakage, keep=["label", *keep])


def vehicle_failure(vehicles: DataFrame, maintenance: DataFrame, vehicle: str, unplanned: str = "unplanned") -> DataFrame:
    """Will the vehicle need any unplanned visit? Identifier and outcome columns are gone."""
    hit = maintenance.where(F.col(unplanned))
    out = flag_members(vehicles, vehicle, hit, vehicle, "_hit").withColumn("label", F.col("_hit").cast("int"))
    return out.drop("_hit", vehicle, "anomaly_flags")


def inventory_shortage(inv: DataFrame, keys: Sequence[str], date: str, flag: str, bucket: Column, drop: Sequence[str] = ()) -> DataFrame:
    """Will the next snapshot be a stockout? The current flag is not a feature."""
    out = lead_label(inv, keys, [date], bucket, flag, "_next").withColumn("label", F.col("_next").cast("int"))
    return out.drop("_next", flag, *keys, "anomaly_flags", *drop)


def fraud(orders: DataFrame, flags: str, label: str = "fraudulent_order", drop: Sequence[str] = ()) -> DataFrame:
    return orders.withColumn("label", has_label(flags, label).cast("int")).drop(flags, "status", "is_late", "delay_minutes", *drop)


def congestion(site_day: DataFrame, site: str, period: str, order_bucket: Column, attributes: DataFrame, q: float = 0.85, lags: Sequence[int] = (1, 2, 7)) -> DataFrame:
    """Is the site unusually busy for itself? Lagged volume and site attributes; same-day columns dropped.

    The rolling mean is taken within the site (a source series that ran on over site borders is not copied).
    """
    cut = exact_quantiles(site_day, [site], "orders_count", {"_cut": q})
    days = site_day.join(cut, site, "inner").withColumn("label", (F.col("orders_count") > F.col("_cut")).cast("int"))

    def columns(w):
        return {f"orders_lag{k}": F.lag("orders_count", k).over(w) for k in lags} | {"orders_roll7": rolling_mean_column(w, 7, 2)}

    made = windowed(days, [site], [period], order_bucket, columns, lookback=max(7, *lags), first=lambda w: prefix_sums(w, "orders_count"))
    out = made.where(F.col("orders_lag1").isNotNull()).withColumns({"dow": F.weekday(period), "month": F.month(period)})
    same_day = ["_cut", "orders_count", "total_weight_kg", "late_rate", "avg_km", "cold_share"]
    return out.join(attributes, site, "left").drop(*same_day)


TASK_BUILDERS: Mapping[str, Callable] = {
    **{n: direct_task for n in DIRECT_TASKS},
    "vehicle_failure": vehicle_failure, "inventory_shortage": inventory_shortage, "fraud_detection": fraud, "warehouse_congestion": congestion,
}


def describe_task(task: DataFrame, kind: str) -> DataFrame:
    """Rows and number of features; positive share for binary labels, mean and deviation for regression."""
    n_features = len([c for c in task.columns if c not in ("label", "split")])
    base = [F.count(F.lit(1)).alias("rows"), F.lit(n_features).alias("features")]
    if kind == "binary":
        base.append(rate(F.col("label") == 1).alias("positive_share"))
    elif kind == "regression":
        base += [F.avg("label").alias("mean"), F.stddev_samp("label").alias("std")]
    else:
        base.append(F.count_distinct("label").alias("classes"))
    return task.agg(*base)
