"""Calendar parts and time arithmetic on zone-less timestamps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970, the zone-less clock read as UTC."""
    return F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), col(ts))


def calendar_parts(ts: str | Column, prefix: str = "order") -> dict[str, Column]:
    t = col(ts)
    return {
        f"{prefix}_year": F.year(t),
        f"{prefix}_month": F.month(t),
        f"{prefix}_day": F.dayofmonth(t),
        f"{prefix}_hour": F.hour(t),
        f"{prefix}_dayofweek": F.weekday(t),
        f"{prefix}_dayofyear": F.dayofyear(t),
        f"{prefix}_week": F.weekofyear(t),
        f"{prefix}_quarter": F.quarter(t),
        f"{prefix}_month_label": F.date_format(t, "yyyy-MM"),
        "is_weekend": F.weekday(t) >= 5,
        "is_business_hours": F.hour(t).between(8, 18),
        "is_night_shift": (F.hour(t) >= 21) | (F.hour(t) < 5),
        "is_peak_hour": F.hour(t).isin(8, 9, 17, 18),
    }


def days_since(ts: str | Column, start: Column) -> Column:
    """Whole elapsed days, floored (not a difference of calendar dates)."""
    return F.floor(F.timestamp_diff("SECOND", start, col(ts)) / 86400)


def cyclical(c: str | Column, period: int) -> tuple[Column, Column]:
    angle = col(c) * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def minutes_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("SECOND", col(start), col(end)) / F.lit(60.0)


def hours_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("SECOND", col(start), col(end)) / F.lit(3600.0)


def floor_time(ts: str | Column, hours: int) -> Column:
    """Floor to a multiple of ``hours`` since midnight 1970-01-01."""
    step = hours * 3600
    secs = F.floor(epoch_seconds(ts) / step) * step
    return F.timestamp_add("SECOND", secs.cast("int"), F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))


def add_minutes(ts: str | Column, minutes: str | Column) -> Column:
    """Shift by a whole number of minutes; fractions are cut off."""
    return F.timestamp_add("MINUTE", col(minutes).cast("int"), col(ts))


def add_seconds(ts: str | Column, seconds: str | Column) -> Column:
    return F.timestamp_add("SECOND", col(seconds).cast("int"), col(ts))


def month_start(ts: str | Column) -> Column:
    return F.trunc(col(ts).cast("date"), "month")
