"""Closed-form delivery models: travel time, status, cost, targets and the leakage guard."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import minutes_between
from ..functions.scalars import bucketize, case_ladder, clip, composite_score, safe_ratio
from .quantiles import exact_quantiles

# Speeds in km/h, regional cost and priority factors.
AREA_SPEED = {"urban": 26.0, "suburban": 42.0}
RURAL_SPEED = 63.0
PRIORITY_SLA_FACTOR = {"same_day": 0.25, "express": 0.5, "scheduled": 1.0, "standard": 1.0, "economy": 1.6}
# Columns known only after the outcome.
LEAKAGE_COLUMNS = [
    "delay_minutes", "is_late", "actual_delivery_ts", "actual_duration_min", "status", "delivery_cost_usd",
    "labour_cost_usd", "fuel_cost_usd", "toll_cost_usd", "handling_cost_usd", "revenue_usd", "margin_usd", "margin_pct",
    "cost_per_km_usd", "cost_per_kg_usd", "speed_kmh_effective", "planned_vs_actual_ratio", "sla_utilisation",
    "route_on_time_rate", "delivery_attempts", "co2_kg", "co2_per_km", "target_risk_score",
]


def travel_time_model(df: DataFrame, area: str, km: str, traffic: str, weather: str, skill: str, service: str, handling: str):
    """Effective speed, travel minutes, planned and actual durations."""
    base = case_ladder([F.col(area) == a for a in AREA_SPEED], list(AREA_SPEED.values()), RURAL_SPEED)
    speed = clip(base / (F.col(traffic) * F.col(weather)) * (F.col(skill) * 0.22 + 0.9), 4.0, 110.0)
    travel = F.col(km) / speed * 60.0
    return df.withColumns({
        "effective_speed": speed, "travel_minutes": travel,
        "actual_duration_min": travel + F.col(service) + F.col(handling),
        "planned_duration_min": F.col(km) / (base * 1.05) * 60.0 + 7.0 + F.col(handling) * 0.8,
    })


def sla_calibration(df: DataFrame, completion_min: str, sla_hours: str, target: float = 0.885) -> DataFrame:
    """Scale all SLAs by one constant so that the share ``target`` of orders completes in time."""
    ratio = F.col(completion_min) / F.greatest(F.col(sla_hours) * 60.0, F.lit(1.0))
    c = exact_quantiles(df.select(ratio.alias("_ratio")), [], "_ratio", {"c": target}).scalar()
    return df.withColumn("_c", c).withColumns(
        {"calibrated_sla_hours": F.col(sla_hours) * F.greatest("_c", F.lit(1e-6))}
    ).drop("_c")


def delivery_status(df: DataFrame, completed: str, promised: str, roll: Column, difficulty: Column, fragile: Column):
    """Status ladder; outcome columns are NULL unless the order was delivered."""
    p_failed = (1 + difficulty) * 0.021
    p_returned = (1 + fragile.cast("int") * 0.6) * 0.014
    delay = minutes_between(promised, completed)
    status = case_ladder(
        [roll < p_failed, roll < p_failed + p_returned, roll < p_failed + p_returned + 0.011, delay > 0],
        ["failed", "returned", "cancelled", "delivered_late"], "delivered",
    )
    done = F.col("status").isin("delivered", "delivered_late")
    return df.withColumn("status", status).withColumns({
        "actual_delivery_ts": F.when(done, F.col(completed)), "delay_minutes": F.when(done, delay),
        "is_late": F.col("status") == "delivered_late",
    })


def cost_model(df: DataFrame, km: str, l100: str, index: str, minutes: str, hourly: str, toll: str, weight: str, items: str, cold: str, revenue: str):
    """Fuel, labour, toll and handling cost, their total, margin and CO2."""
    return df.withColumns({
        "fuel_cost": F.col(km) * F.col(l100) / 100.0 * 1.65 * F.col(index),
        "labour_cost": F.col(minutes) / 60.0 * F.col(hourly),
        "toll_cost": F.col(toll) * F.col(index),
        "handling_cost": (F.col(weight) * 0.012 + F.col(items) * 0.22 + F.col(cold).cast("int") * 3.1) * F.col(index),
        "co2_kg": F.col(km) * F.col(l100) / 100.0 * 2.68,
    }).withColumn(
        "delivery_cost", F.col("fuel_cost") + F.col("labour_cost") + F.col("toll_cost") + F.col("handling_cost")
    ).withColumn("margin", F.col(revenue) - F.col("delivery_cost"))


def environment_stress(severity: str, congestion: str) -> Column:
    return composite_score([(0.55, severity, 0.0), (0.45, congestion, 0.4)])


def add_targets(
    df: DataFrame, delay: str = "delay_minutes", actual_ts: str = "actual_delivery_ts", duration="actual_duration_min",
    cost="delivery_cost_usd", env="env_stress_index", difficulty="zone_difficulty", fragile="fragile",
    cold="cold_chain_required", status="status",
) -> DataFrame:
    """Six targets; an unknown outcome keeps a NULL target."""
    lost = F.coalesce(F.col(status).isin("failed", "returned"), F.lit(False))
    risk = composite_score([
        (0.42, clip(F.coalesce(F.col(delay), F.lit(0)) / 120.0, 0.0, 1.0), None), (0.22, env, 0.3), (0.14, difficulty, 0.5),
        (0.08, F.col(fragile).cast("int"), None), (0.08, F.col(cold).cast("int"), None), (0.30, lost.cast("int"), None),
    ])
    return df.withColumns({
        "target_delay_minutes": F.col(delay),
        "target_is_late": F.when(F.col(actual_ts).isNotNull(), F.coalesce(F.col(delay) > 0, F.lit(False)).cast("double")),
        "target_eta_minutes": F.col(duration),
        "target_delivery_cost": F.col(cost),
        "target_risk_score": risk,
        "target_risk_bucket": bucketize(risk, [0.25, 0.5], ["low", "medium", "high"]),
        "target_will_be_returned": F.coalesce(F.col(status) == "returned", F.lit(False)).cast("int"),
    })


def drop_columns(df: DataFrame, listed: Iterable[str] = LEAKAGE_COLUMNS, keep: Iterable[str] = ()) -> DataFrame:
    """Leakage guard: listed columns and their missing-flags, other targets, identifiers, label lists."""
    listed, keep = set(listed), set(keep)

    def leaks(c: str) -> bool:
        stem = c.removesuffix("__was_missing")
        return stem in listed or stem.startswith("target_") or stem.endswith("_id") or stem.endswith("anomaly_flags")

    return df.drop(*[c for c in df.columns if c not in keep and leaks(c)])


def filter_known_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def high_value_flag(df: DataFrame, c: str, q: float = 0.9, out: str = "is_high_value", source: DataFrame | None = None) -> DataFrame:
    """Above the global quantile; the threshold is one scalar computed first, from ``source`` if given."""
    cut = exact_quantiles(df if source is None else source, [], c, {"cut": q}).scalar()
    return df.withColumn("_cut", cut).withColumn(out, F.coalesce(F.col(c) > F.col("_cut"), F.lit(False))).drop("_cut")


def efficiency_ratios(ratios: Mapping[str, tuple[str, str, float]]) -> dict[str, Column]:
    """``out: (numerator, denominator, floor)`` as columns."""
    return {out: safe_ratio(n, d, floor) for out, (n, d, floor) in ratios.items()}
