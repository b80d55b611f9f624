"""Grids and row expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import add_minutes, add_seconds, minutes_between
from ..functions.geo import bearing_deg, interpolate_point
from ..functions.scalars import case_ladder, clip, col

# The standard flow of a parcel's middle events.
STANDARD_FLOW = ["order_created", "picked", "packed", "dispatched", "in_transit", "out_for_delivery", "delivery_attempted"]
TERMINAL_EVENTS = {
    "delivered": "delivered", "delivered_late": "delivered", "failed": "exception", "returned": "returned", "cancelled": "exception",
}


def time_spine(entities: DataFrame, start: str, end: str, hours: int, out: str = "timestamp") -> DataFrame:
    """Entity x time grid with an exclusive end; steps are generated on each entity row."""
    last = F.to_timestamp_ntz(F.lit(end)) - F.expr("interval 1 second")
    step = F.expr(f"interval {hours} hours")
    return entities.withColumn(out, F.explode(F.sequence(F.to_timestamp_ntz(F.lit(start)), last, step)))


def snapshot_spine(sites: DataFrame, skus: Sequence, start: str, end: str, days: int) -> DataFrame:
    """Site x SKU x date grid; ``skus`` is a short constant list carried on each site row."""
    dates = F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1), F.expr(f"interval {days} days"))
    return sites.withColumn("sku_id", F.explode(F.array(*[F.lit(s) for s in skus]))).withColumn("snapshot_date", F.explode(dates))


def expand_rows(df: DataFrame, n: str | Column, step: str = "step", progress: str = "progress") -> DataFrame:
    """Repeat each row ``n`` times with step 0..n-1 and progress i/(n-1)."""
    count = col(n).cast("int")
    steps = df.withColumn("_n", count).where("_n >= 1").withColumn(step, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return steps.withColumn(progress, F.col(step) / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_n")


def trajectory_points(legs: DataFrame, n: str | Column, start_ts: str, duration_min: str, km: str) -> DataFrame:
    """Densify each leg (o_lat, o_lon, d_lat, d_lon) to timed points with heading and a speed profile."""
    pts = expand_rows(legs, n)
    lat, lon = interpolate_point("o_lat", "o_lon", "d_lat", "d_lon", "progress")
    minutes = F.coalesce(duration_min, F.lit(45.0))
    nominal = F.coalesce(km, F.lit(5.0)) / F.greatest(minutes / 60.0, F.lit(0.02))
    wave = F.sin(clip("progress", 0.02, 0.98) * F.pi()) * 1.3 + 0.35
    return pts.withColumns({
        "latitude": lat, "longitude": lon,
        "ping_ts": add_seconds(start_ts, F.floor(minutes * F.col("progress") * 60)),
        "heading_deg": bearing_deg("o_lat", "o_lon", "d_lat", "d_lon"),
        "speed_kmh": clip(nominal * wave, 0.0, 130.0),
        "progress_pct": F.col("progress") * 100,
        "ignition_on": F.col("progress") < 0.97,
    })


def event_timeline(orders: DataFrame, n: str | Column, start_ts: str, pickup_ts: str, duration_min: str, status: str) -> DataFrame:
    """Per-order events: middle ones from the standard flow by progress, the last one mirrors the status."""
    ev = expand_rows(orders.withColumn("_events", col(n).cast("int")), "_events")
    last = F.col("step") == F.col("_events") - 1
    flow = F.array(*[F.lit(e) for e in STANDARD_FLOW])
    spot = clip(F.floor(F.col("progress") * (len(STANDARD_FLOW) - 1)).cast("int"), 0, len(STANDARD_FLOW) - 1)
    terminal = case_ladder([F.col(status) == s for s in TERMINAL_EVENTS], list(TERMINAL_EVENTS.values()), "in_transit")
    span = F.coalesce(duration_min, F.lit(120.0)) + F.floor(minutes_between(start_ts, pickup_ts))
    return ev.withColumns({
        "event_type": F.when(last, terminal).otherwise(F.element_at(flow, spot + 1)),
        "event_ts": add_seconds(start_ts, F.floor(F.greatest(span, F.lit(5.0)) * F.col("progress") * 60)),
        "event_sequence": F.col("step") + 1, "is_terminal": last,
    }).drop("_events")


def future_spine(last_day: DataFrame, horizon: int) -> DataFrame:
    """``horizon`` days after the one day in ``last_day.day``; h counts from 1."""
    days = last_day.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return days.select(F.date_add("day", F.col("h")).alias("day"), "h")


def promised_times(df: DataFrame, order_ts: str, pickup_lag_min: str, duration_min: str, sla_hours: str) -> DataFrame:
    """Pickup, promised and actual times in whole minutes."""
    pickup = add_minutes(order_ts, pickup_lag_min)
    return df.withColumns({
        "pickup_ts": pickup, "promised_ts": add_minutes(order_ts, col(sla_hours) * 60),
        "completed_ts": add_minutes(pickup, duration_min),
    })
