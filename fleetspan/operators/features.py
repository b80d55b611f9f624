"""The wide feature table: calendar, holidays, geography, look-ups, ratios and leak-free history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import calendar_parts, cyclical, days_since
from ..functions.scalars import bucketize, case_ladder, clip, safe_ratio
from .joins import calendar_join, lookup_join
from .ordered import history_features, time_bucket
from .physics import high_value_flag

DISTANCE_EDGES = [5, 15, 40, 100, 300]


def build_features(
    orders: DataFrame, dims: Sequence[tuple[DataFrame, str, str, Mapping[str, str]]], order_key: Sequence[str],
    history: Mapping[str, str], ts: str = "order_ts", late: str | Column = "is_late", delay: str | Column = "delay_days",
    holidays: DataFrame | None = None, country: str = "country", high_value: str | None = "value", step: int = 86400,
    start_from: DataFrame | None = None, value_from: DataFrame | None = None, derived: Mapping[str, Column] | None = None,
    sizes_from: Mapping[str, DataFrame] | None = None, totals_from: DataFrame | None = None,
) -> DataFrame:
    """``dims``: (table, foreign key, primary key, columns); ``history``: prefix to key column.

    ``start_from`` and ``value_from`` may name narrower tables with the same times and values; the first
    time and the value threshold are then found without repeating the joins behind ``orders``; ``sizes_from`` (by prefix)
    and ``totals_from`` do the same for the sizes of history keys and for the totals where large ones are cut. Look-ups are left joins whose broadcast is decided by size, and each history key
    costs a shuffle, which the look-up by that key shares. So these come first, on the few columns of ``orders``;
    ``derived`` columns and all others follow, where nothing moves any more.
    """
    df, left = orders, list(dims)
    for prefix, key in history.items():
        for dim in [d for d in left if d[1] == key]:
            df = lookup_join(df, *dim)
            left.remove(dim)
        df = history_features(df, [key], [ts, *order_key], time_bucket(ts, step), late, delay, prefix=prefix, sizes_from=(sizes_from or {}).get(prefix), totals_from=totals_from)
    for table, fk, pk, columns in left:
        df = lookup_join(df, table, fk, pk, columns)
    df = df.withColumns(calendar_parts(ts) | dict(derived or {}))
    start = (orders if start_from is None else start_from).agg(F.min(ts)).scalar()
    df = df.withColumn("_start", start).withColumn("days_since_start", days_since(ts, F.col("_start"))).drop("_start")
    for c, period, name in (("order_hour", 24, "hour"), ("order_dayofweek", 7, "dow"), ("order_month", 12, "month")):
        s, co = cyclical(c, period)
        df = df.withColumns({f"{name}_sin": s, f"{name}_cos": co})
    if holidays is not None:
        df = calendar_join(df, holidays, country, ts)
    df = df.withColumns({
        "distance_bucket": bucketize("km", DISTANCE_EDGES, unit="km"), "is_long_haul": F.col("km") > 150, "is_last_mile": F.col("km") <= 15,
        "log_weight": F.log1p(clip("weight_kg", lo=0.0)), "is_heavy": F.col("weight_kg") > 50,
        "density_kg_per_m3": safe_ratio("weight_kg", "volume_m3", 1e-4),
        "weight_class": case_ladder([F.col("weight_kg") < 5, F.col("weight_kg") < 20], ["light", "medium"], "heavy"),
    })
    if high_value:
        df = high_value_flag(df, high_value, source=value_from)
        df = df.withColumns({"log_value": F.log1p(clip(high_value, lo=0.0)), "value_per_kg": safe_ratio(high_value, "weight_kg", 0.01)})
    return df.withColumns({
        "cost_per_km": safe_ratio("cost", "km", 0.1), "cost_per_kg": safe_ratio("cost", "weight_kg", 0.01),
        "margin": F.col("revenue") - F.col("cost"), "margin_pct": safe_ratio(F.col("revenue") - F.col("cost"), "revenue", 0.01),
        "speed_kmh_effective": F.col("km") / (clip(F.abs("duration_min"), lo=1.0) / 60),
        "co2_per_km": safe_ratio("co2", "km", 0.1),
    })
