"""Group aggregates, marts' building blocks and the additive fact cube.

Every aggregate combines partially before its shuffle, so a frequent group key costs one partial row per
task. NULL group keys are dropped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_start
from ..functions.scalars import case_ladder, clip, col, composite_score, exact_avg, exact_sum, rate, safe_ratio
from .quantiles import exact_quantiles
from .sets import top_k

# The additive measures of the cube and the ledger's cost categories.
CUBE_MEASURES = ["orders", "revenue", "cost", "late", "failed", "km", "co2", "duration"]
COST_CATEGORIES = ["fuel", "labour", "maintenance", "tolls", "insurance", "warehousing", "overhead", "penalties"]


def on_time_pct(flag: str | Column = "is_late") -> Column:
    return (1 - rate(flag)) * 100


def group_kpis(df: DataFrame, by: str, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Orders, revenue, cost, margin and on-time share of each group."""
    out = df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("orders"), exact_sum("revenue").alias("revenue"), exact_sum("cost").alias("cost"),
        on_time_pct().alias("on_time"), *[c.alias(n) for n, c in (extra or {}).items()],
    )
    return out.withColumn("margin", F.col("revenue") - F.col("cost"))


def network_kpis(df: DataFrame) -> DataFrame:
    """One row of totals and rates over all deliveries."""
    out = df.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(F.col("status").isin("delivered", "delivered_late")).alias("delivered"),
        on_time_pct().alias("on_time_rate"),
        exact_sum("revenue").alias("revenue"), exact_sum("cost").alias("cost"),
        exact_avg("km").alias("avg_km"), exact_sum("km").alias("total_km"),
        (exact_sum("co2") / 1000).alias("co2_tonnes"),
        (rate(F.col("status") == "failed") * 100).alias("failed_rate"),
        (rate(F.col("status") == "returned") * 100).alias("return_rate"),
    )
    margin = F.col("revenue") - F.col("cost")
    return out.withColumns({
        "margin": margin,
        "margin_pct": F.try_divide(margin * 100, F.col("revenue")),
        "avg_cost_per_order": F.col("cost") / F.greatest(F.col("total_orders"), F.lit(1)),
    })


def status_mix(df: DataFrame, c: str) -> DataFrame:
    """Value counts and share in percent of all rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("orders")).withColumn(
        "share", F.col("orders") * 100 / total
    )


def fact_cube(df: DataFrame, dims: Sequence[str], ts: str = "order_ts") -> DataFrame:
    """Additive measures by dimensions and month; small enough to be re-aggregated at will."""
    return df.dropna(subset=list(dims)).groupBy(*dims, F.date_format(ts, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), exact_sum("revenue").alias("revenue"), exact_sum("cost").alias("cost"),
        F.count_if("is_late").alias("late"), F.count_if(F.col("status") == "failed").alias("failed"),
        exact_sum("km").alias("km"), exact_sum("co2").alias("co2"), exact_sum("duration_min").alias("duration"),
    )


def cube_ratios(df: DataFrame) -> DataFrame:
    """Ratios of re-summed measures; never averaged from ratios."""
    margin = F.col("revenue") - F.col("cost")
    return df.withColumns({
        "margin": margin,
        "on_time": F.try_divide((F.col("orders") - F.col("late")) * 100.0, F.col("orders")),
        "margin_pct": F.try_divide(margin * 100, F.col("revenue")),
        "cost_per_order": F.try_divide(F.col("cost"), F.col("orders")),
    })


def _resum() -> list[Column]:
    whole = {"orders", "late", "failed"}
    return [
        (F.coalesce(F.sum(m), F.lit(0)) if m in whole else exact_sum(m)).alias(m) for m in CUBE_MEASURES
    ]


def reaggregate(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cube_ratios(cube.groupBy(*by).agg(*_resum()))


def cube_rollup(cube: DataFrame, dims: Sequence[str]) -> DataFrame:
    """All combinations of filtered and unfiltered dimensions; ``all`` stands for the unfiltered one."""
    out = cube.cube(*dims).agg(F.grouping_id().cast("long").alias("level"), *_resum())
    bits = len(dims)
    for i, d in enumerate(dims):
        grouped_out = F.col("level").bitwiseAND(1 << (bits - 1 - i)) != 0
        out = out.withColumn(d, F.when(grouped_out, "all").otherwise(F.col(d)))
    return cube_ratios(out)


def slice_cube(cube: DataFrame, **filters: str) -> DataFrame:
    """Equality filters where ``all`` leaves a dimension open."""
    conds = [F.col(d) == v for d, v in filters.items() if v != "all"]
    return reduce(lambda df, c: df.where(c), conds, cube)


def route_rollup(
    stops: DataFrame, vehicles: DataFrame, route: Sequence[str], seq: Sequence[str], vehicle: str, firsts: Sequence[str],
    ts: str = "order_ts",
) -> DataFrame:
    """Stops to routes: first values in stop order, sums, time span, utilisation, labels.

    ``vehicles`` has (vehicle key, capacity_kg, capacity_m3).
    """
    order = F.struct(*seq)
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in [vehicle, *firsts]]
    agg = stops.dropna(subset=[*route, vehicle]).groupBy(*route).agg(
        *first,
        F.count(F.lit(1)).alias("stops"), exact_sum("km").alias("planned_km"),
        exact_sum("duration_min").alias("actual_duration_min"), exact_sum("weight_kg").alias("total_weight_kg"),
        exact_sum("volume_m3").alias("total_volume_m3"), exact_sum("cost").alias("route_cost"),
        F.count_if("is_late").alias("late_stops"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"),
    )
    shrink = clip(1.0 - (F.col("stops") - 1) * 0.028, 0.42, 1.0)
    stop_ladder = case_ladder(
        [F.col("stops") <= 3, F.col("stops") <= 10, F.col("stops") <= 20],
        ["direct", "short_multistop", "standard_multistop"], "dense_multistop",
    )
    joined = agg.join(vehicles, vehicle, "left")
    return (
        joined.withColumns({
            "actual_km": F.col("planned_km") * shrink,
            "utilisation_kg": clip(safe_ratio("total_weight_kg", "capacity_kg", 1e-6), 0.0, 3.0),
            "utilisation_m3": clip(safe_ratio("total_volume_m3", "capacity_m3", 1e-6), 0.0, 3.0),
            "on_time_rate": 1 - F.col("late_stops") / F.col("stops"),
            "cost_per_stop": F.col("route_cost") / F.col("stops"),
            "route_type": stop_ladder,
        })
        .withColumns({
            "overloaded": F.coalesce(F.col("utilisation_kg") > 1.0, F.lit(False)),
            "cost_per_km": safe_ratio("route_cost", "actual_km", 0.1),
            "km_gap": F.col("actual_km") - F.col("planned_km"),
        })
        .withColumn("disrupted", (F.col("on_time_rate") < 0.7) | F.col("overloaded"))
        .drop("capacity_kg", "capacity_m3")
    )


def monthly_ledger(
    df: DataFrame, sites: DataFrame, site: str, factors: Mapping[str, Column], budget: Column, ts: str = "order_ts",
) -> DataFrame:
    """Site-month sums unpivoted to the cost categories, with budget, variance and cost per order.

    ``factors`` gives the random rate of the volume-driven categories; ``budget`` the budget factor, both
    as expressions over (site, month, category). ``sites`` has (site, cost_index, monthly_fixed_cost).
    """
    monthly = df.dropna(subset=[site]).groupBy(site, month_start(ts).alias("month")).agg(
        F.count(F.lit(1)).alias("orders_count"), exact_sum("fuel_cost").alias("fuel"),
        exact_sum("labour_cost").alias("labour"), exact_sum("toll_cost").alias("tolls"), exact_sum("km").alias("km"),
    )
    base = monthly.join(sites, site, "left")
    per_order = {c: F.col("orders_count") * factors[c] * F.col("cost_index") for c in ("insurance", "penalties", "overhead")}
    amounts = {
        "maintenance": F.col("km") * factors["maintenance"] * F.col("cost_index"),
        "warehousing": F.col("monthly_fixed_cost") * factors["warehousing"],
        **per_order,
    }
    wide = base.withColumns(amounts)
    long = wide.unpivot([site, "month", "orders_count"], list(COST_CATEGORIES), "category", "amount")
    return (
        long.withColumn("amount", clip("amount", lo=0.0))
        .withColumn("budget", F.col("amount") * budget)
        .withColumns({
            "variance": F.col("amount") - F.col("budget"),
            "cost_per_order": safe_ratio("amount", "orders_count", 1),
        })
    )


def courier_scorecard(df: DataFrame, driver: str, ratings: DataFrame | None = None, ts: str = "order_ts") -> DataFrame:
    """Driver-month counts, rates and the 0-100 score. ``ratings``: (driver, month, rating)."""
    work = df.where(F.col(driver).isNotNull()).withColumn("month", month_start(ts))
    agg = work.groupBy(driver, "month").agg(
        F.count(F.lit(1)).alias("deliveries"), F.count_if("is_late").alias("late_deliveries"),
        F.count_if(F.col("status") == "failed").alias("failed_deliveries"),
        exact_sum("km").alias("total_km"), exact_sum("duration_min").alias("total_duration_min"),
        exact_sum("cost").alias("total_cost"), exact_sum("revenue").alias("total_revenue"),
        exact_avg("delay_days").alias("avg_delay"),
    )
    if ratings is not None:
        fb = ratings.where(F.col(driver).isNotNull()).groupBy(driver, "month").agg(exact_avg("rating").alias("avg_rating"))
        agg = agg.join(fb, [driver, "month"], "left")
    else:
        agg = agg.withColumn("avg_rating", F.lit(None).cast("double"))
    out = agg.withColumns({
        "on_time_rate": 1 - F.col("late_deliveries") / F.col("deliveries"),
        "success_rate": 1 - F.col("failed_deliveries") / F.col("deliveries"),
        "deliveries_per_hour": F.col("deliveries") / clip(F.col("total_duration_min") / 60, lo=0.5),
        "cost_per_delivery": F.col("total_cost") / F.col("deliveries"),
        "margin": F.col("total_revenue") - F.col("total_cost"),
        "km_per_delivery": F.col("total_km") / F.col("deliveries"),
    })
    score = composite_score([
        (45.0, "on_time_rate", 0.0), (25.0, "success_rate", 0.0),
        (20.0, F.coalesce("avg_rating", F.lit(4.0)) / 5, None),
        (10.0, clip(F.col("deliveries_per_hour") / 4, 0.0, 1.0), None),
    ])
    return out.withColumn("performance_score", score)


def site_period_features(df: DataFrame, site: str, period: Column, name: str = "period") -> DataFrame:
    return df.where(F.col(site).isNotNull()).groupBy(site, period.alias(name)).agg(
        F.count(F.lit(1)).alias("orders_count"), exact_sum("weight_kg").alias("total_weight_kg"),
        exact_avg("km").alias("avg_km"), rate("is_late").alias("late_rate"), rate("cold").alias("cold_share"),
    )


def demand_grid(df: DataFrame, ts: str) -> DataFrame:
    """Weekday x hour counts, all 168 cells present."""
    counts = df.groupBy(F.weekday(ts).alias("d"), F.hour(ts).alias("h")).agg(F.count(F.lit(1)).alias("orders"))
    cell = F.explode(F.sequence(F.lit(0), F.lit(167))).alias("c")
    spine = df.sparkSession.range(1).select(cell).select(
        F.floor(F.col("c") / 24).cast("int").alias("d"), (F.col("c") % 24).alias("h")
    )
    return spine.join(counts, ["d", "h"], "left").select("d", "h", F.coalesce("orders", F.lit(0)).alias("orders"))


def period_profile(df: DataFrame, period: Column, name: str, latest: int | None = None) -> DataFrame:
    """Count, on-time share, mean delay and cost per period; ``latest`` keeps the last periods only."""
    out = df.groupBy(period.alias(name)).agg(
        F.count(F.lit(1)).alias("orders"), on_time_pct().alias("on_time"),
        exact_avg("delay_days").alias("avg_delay"), exact_sum("cost").alias("cost"),
    ).where(F.col(name).isNotNull())
    return top_k(out, [F.col(name).desc()], latest) if latest else out


def impact_table(df: DataFrame, condition: str) -> DataFrame:
    return df.where(F.col(condition).isNotNull()).groupBy(condition).agg(
        F.count(F.lit(1)).alias("orders"), (rate("is_late") * 100).alias("late_rate"),
        exact_avg("delay_days").alias("avg_delay"),
    )


def fleet_utilisation(vehicles: DataFrame, df: DataFrame, maintenance: DataFrame, vehicle: str) -> DataFrame:
    """Per-vehicle work and upkeep; utilisation is relative to the busiest vehicle."""
    work = df.dropna(subset=[vehicle]).groupBy(vehicle).agg(
        F.count(F.lit(1)).alias("deliveries"), exact_sum("km").alias("km"), exact_sum("cost").alias("cost"),
        rate("is_late").alias("late"),
    )
    upkeep = maintenance.dropna(subset=[vehicle]).groupBy(vehicle).agg(
        F.count(F.lit(1)).alias("events"), exact_sum("maint_cost").alias("maint_cost"),
        F.count_if("unplanned").alias("unplanned"),
    )
    zero = {"deliveries": 0, "km": 0.0, "cost": 0.0, "late": 0.0, "events": 0, "maint_cost": 0.0, "unplanned": 0}
    busiest = work.agg(F.coalesce(F.max("deliveries"), F.lit(0))).scalar()
    joined = vehicles.join(work, vehicle, "left").join(upkeep, vehicle, "left").fillna(zero)
    return joined.withColumn("utilisation", F.col("deliveries") * 100 / F.greatest(busiest, F.lit(1)))


def fleet_summary(vehicles: DataFrame, maintenance: DataFrame, year: int = 2026) -> DataFrame:
    upkeep = maintenance.agg(
        exact_sum("maint_cost").alias("total_maintenance_cost"), (rate("unplanned") * 100).alias("unplanned_share")
    )
    fleet = vehicles.agg(
        F.count(F.lit(1)).alias("total_vehicles"), F.count_if(F.col("vehicle_status") == "active").alias("active"),
        (F.lit(float(year)) - exact_avg("model_year")).alias("avg_age_years"),
        (rate(F.col("fuel_type") == "electric") * 100).alias("electric_share"),
    )
    return fleet.select("*", upkeep.select("total_maintenance_cost").scalar().alias("total_maintenance_cost"),
                        upkeep.select("unplanned_share").scalar().alias("unplanned_share"))


def fleet_by_type(fleet: DataFrame, by: str = "vehicle_type") -> DataFrame:
    return fleet.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("vehicles"), F.sum("deliveries").alias("deliveries"), exact_sum("km").alias("km"),
        exact_avg("utilisation", 8).alias("avg_utilisation"), exact_avg("capacity_kg").alias("avg_capacity"),
    )


def age_profile(vehicles: DataFrame, year: int = 2026) -> DataFrame:
    return vehicles.groupBy((F.lit(year) - F.col("model_year")).alias("age")).agg(F.count(F.lit(1)).alias("n"))


def maintenance_by_type(maintenance: DataFrame, by: str) -> DataFrame:
    return maintenance.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("events"), exact_sum("maint_cost").alias("cost"),
        (rate("unplanned") * 100).alias("unplanned_rate"),
    )


def driver_ranking(scorecard: DataFrame, driver: str, k: int = 25) -> DataFrame:
    means = scorecard.groupBy(driver).agg(
        F.sum("deliveries").alias("deliveries"), exact_avg("on_time_rate", 12).alias("on_time"),
        exact_avg("performance_score", 12).alias("score"), exact_avg("cost_per_delivery", 8).alias("cost_per_delivery"),
    )
    return top_k(means, [F.col("score").desc_nulls_last(), F.col(driver)], k)


def score_histogram(scorecard: DataFrame, score: str = "performance_score") -> DataFrame:
    """Counts per whole point (half to even, as the display rounds)."""
    return scorecard.where(F.col(score).isNotNull()).groupBy(F.bround(score, 0).alias("score")).agg(
        F.count(F.lit(1)).alias("n")
    )


def site_throughput(sites: DataFrame, df: DataFrame, site: str, day: Column) -> DataFrame:
    """Peak-day orders against rated capacity; sites without orders stay with zero."""
    daily = df.dropna(subset=[site]).groupBy(site, day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    peak = daily.groupBy(site).agg(F.max("_n").alias("peak_day_orders"), F.sum("_n").alias("orders"))
    return sites.join(peak, site, "left").fillna({"peak_day_orders": 0, "orders": 0}).withColumn(
        "capacity_used_pct", safe_ratio("peak_day_orders", "daily_capacity", 1.0) * 100
    )


def inventory_summary(inv: DataFrame) -> DataFrame:
    median = exact_quantiles(inv, [], "days_of_cover", {"m": 0.5}).select("m").scalar()
    return inv.agg(
        F.count(F.lit(1)).alias("sku_locations"), (rate("stockout_flag") * 100).alias("stockout_rate"),
        exact_sum("units_on_hand").alias("total_units"),
        exact_sum(F.coalesce("units_on_hand", F.lit(0)) * F.coalesce("unit_cost", F.lit(0))).alias("stock_value"),
    ).withColumn("median_days_cover", median)


def inventory_by_category(inv: DataFrame, by: str) -> DataFrame:
    return inv.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("sku_locations"), exact_sum("units_on_hand").alias("units"),
        (rate("stockout_flag") * 100).alias("stockout_rate"), exact_avg("turnover_rate", 6).alias("turnover"),
        exact_sum("unit_cost").alias("value"),
    )


def value_counts(df: DataFrame, c: str, n: str = "n") -> DataFrame:
    return df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias(n))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column, n_unique). Exact counts de-duplicate (column, value) pairs, so no column is one task's work."""
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return wide.unpivot([], list(columns), "column", "n_unique")
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    pairs = text.unpivot([], list(columns), "column", "value").where(F.col("value").isNotNull()).distinct()
    counts = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column")
    return df.sparkSession.range(1).select(names).join(counts, "column", "left").fillna({"n_unique": 0})


def group_quantile(df: DataFrame, by: Sequence[str], c: str, q: float, out: str = "threshold") -> DataFrame:
    return exact_quantiles(df, by, c, {out: q})


def share_above(df: DataFrame, by: Sequence[str], flag: Column, threshold: float = 0.5) -> DataFrame:
    share = df.dropna(subset=list(by)).groupBy(*by).agg(rate(flag).alias("share"))
    return share.where(F.col("share") >= threshold)


def cost_breakdown(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Column sums as (category, amount) rows; ``columns`` maps category to column."""
    wide = df.agg(*[exact_sum(c).alias(n) for n, c in columns.items()])
    return wide.unpivot([], list(columns), "category", "amount")


def group_mean_gap(df: DataFrame, flag: Column, columns: Sequence[str]) -> DataFrame:
    """Mean of each column in flagged and other rows; ``gap`` is in units of the overall deviation."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.avg(F.when(flag, x)).alias(f"a_{c}"), F.avg(F.when(~flag, x)).alias(f"b_{c}")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("flagged_mean"), F.col(f"b_{c}").alias("normal_mean"))
        for c in columns
    ])).alias("r")
    return one.select(rows).select("r.*").withColumn("gap", F.abs(F.col("flagged_mean") - F.col("normal_mean")))


def elasticities(df: DataFrame, x: str, adverse: Column) -> DataFrame:
    """Late-rate gap between top and bottom quartile of ``x`` and between adverse and other rows."""
    q = exact_quantiles(df, [], x, {"q1": 0.25, "q3": 0.75})
    tagged = df.withColumns({"_q1": q.select("q1").scalar(), "_q3": q.select("q3").scalar()})
    late = F.col("is_late").cast("int")
    return tagged.agg(
        (F.avg(F.when(F.col(x) >= F.col("_q3"), late)) - F.avg(F.when(F.col(x) <= F.col("_q1"), late))).alias("quartile_gap"),
        (F.avg(F.when(adverse, late)) - F.avg(F.when(~adverse, late))).alias("adverse_gap"),
    )


def cost_structure(df: DataFrame, vehicles: DataFrame, drivers: DataFrame, sites: DataFrame) -> DataFrame:
    """Cost shares, unit rates and the load per resource of the whole network."""
    n = {k: d.agg(F.count(F.lit(1))).scalar() for k, d in (("v", vehicles), ("d", drivers), ("s", sites))}
    base = df.agg(
        F.count(F.lit(1)).alias("orders"), exact_sum("fuel_cost").alias("fuel"), exact_sum("labour_cost").alias("labour"),
        (exact_sum("toll_cost") + exact_sum("handling_cost")).alias("other"), exact_sum("cost").alias("total_cost"),
        exact_sum("revenue").alias("total_revenue"), exact_sum("km").alias("total_km"),
        exact_sum("co2").alias("total_co2"), on_time_pct().alias("on_time_rate"),
    ).withColumns({"fleet_size": n["v"], "drivers": n["d"], "sites": n["s"]})
    parts = F.col("fuel") + F.col("labour") + F.col("other")
    return base.withColumns({
        "fuel_share": F.col("fuel") / parts, "labour_share": F.col("labour") / parts, "other_share": F.col("other") / parts,
        "fuel_per_km": F.col("fuel") / F.col("total_km"), "labour_per_order": F.col("labour") / F.col("orders"),
        "cost_per_order": F.col("total_cost") / F.col("orders"), "km_per_order": F.col("total_km") / F.col("orders"),
        "orders_per_vehicle": F.col("orders") / F.greatest(F.col("fleet_size"), F.lit(1)),
        "orders_per_driver": F.col("orders") / F.greatest(F.col("drivers"), F.lit(1)),
        "orders_per_site": F.col("orders") / F.greatest(F.col("sites"), F.lit(1)),
    })


def conditional_count(df: DataFrame, by: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    return df.dropna(subset=list(by)).groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def exception_counts(df: DataFrame, flags: str) -> DataFrame:
    """Counts by the first label of each flagged row."""
    first = F.split(col(flags), ";")[0]
    return df.where(F.coalesce(flags, F.lit("")) != "").groupBy(first.alias("flag")).agg(F.count(F.lit(1)).alias("n"))
