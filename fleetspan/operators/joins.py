"""Look-ups, panel joins, membership and geography joins.

No side is broadcast by hint unless its size is fixed by construction. Everything else is left to the
size-checked automatic choice and to adaptive skew splitting.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import epoch_seconds, floor_time
from ..functions.geo import EARTH_RADIUS_KM, haversine_km
from ..functions.scalars import col


def lookup_join(fact: DataFrame, dim: DataFrame, fk: str, pk: str, columns: Mapping[str, str], salt: int = 1) -> DataFrame:
    """N:1 left look-up of renamed columns: ``columns`` maps dimension column to output column.

    ``salt > 1`` spreads each foreign key over that many partitions against as many copies of the
    (narrow) dimension, for a key so frequent that adaptive splitting is not enough.
    """
    right = dim.select(F.col(pk).alias("_pk"), *[F.col(c).alias(o) for c, o in columns.items()])
    if salt <= 1:
        return fact.join(right, fact[fk] == right["_pk"], "left").drop("_pk")
    left = fact.withColumn("_s", F.pmod(F.xxhash64(*[c for c in fact.columns]), F.lit(salt)).cast("int"))
    right = right.withColumn("_s2", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    hit = (left[fk] == right["_pk"]) & (left["_s"] == right["_s2"])
    return left.join(right, hit, "left").drop("_pk", "_s", "_s2")


def grid_floor_join(
    fact: DataFrame, panel: DataFrame, keys: Mapping[str, str], ts: str, panel_ts: str, hours: int,
    columns: Mapping[str, tuple[str, object]],
) -> DataFrame:
    """Each fact takes the panel row of its floored time; ``columns``: panel column to (output, default)."""
    right = panel.select(
        *[F.col(p).alias(f"_k{i}") for i, p in enumerate(keys.values())],
        F.col(panel_ts).alias("_pt"), *[F.col(c).alias(f"_o_{o}") for c, (o, _) in columns.items()],
    )
    left = fact.withColumn("_ft", floor_time(ts, hours))
    hit = reduce(
        lambda a, b: a & b, [left[k] == right[f"_k{i}"] for i, k in enumerate(keys)] + [left["_ft"] == right["_pt"]]
    )
    joined = left.join(right, hit, "left")
    return joined.select(*fact.columns, *[F.coalesce(f"_o_{o}", F.lit(d)).alias(o) for o, d in columns.values()])


def calendar_join(fact: DataFrame, holidays: DataFrame, country: str, ts: str, hol_country="country", hol_date="date"):
    """Holiday flag, shopping-event flag and demand multiplier (1.0 on ordinary days)."""
    h = holidays.select(
        F.col(hol_country).alias("_c"), F.col(hol_date).cast("date").alias("_d"),
        F.col("holiday_type").alias("_type"), F.col("demand_multiplier").alias("_mult"),
    )
    joined = fact.join(h, (fact[country] == h["_c"]) & (fact[ts].cast("date") == h["_d"]), "left")
    return joined.select(
        *fact.columns,
        F.col("_type").isNotNull().alias("is_holiday"),
        F.coalesce("_mult", F.lit(1.0)).alias("holiday_demand_multiplier"),
        F.coalesce(F.col("_type") == "shopping_event", F.lit(False)).alias("is_shopping_event"),
    )


def anti_join_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows whose non-null key has no parent."""
    known = parent.select(F.col(pk).alias("_pk")).distinct()
    return child.where(F.col(fk).isNotNull()).join(known, child[fk] == known["_pk"], "left_anti")


def semi_join_members(df: DataFrame, key: str, members: DataFrame, member_key: str) -> DataFrame:
    m = members.select(F.col(member_key).alias("_mk"))
    return df.join(m, df[key] == m["_mk"], "left_semi")


def flag_members(df: DataFrame, key: str, members: DataFrame, member_key: str, out: str) -> DataFrame:
    """All rows, with a flag telling whether the key occurs among the members."""
    m = members.where(F.col(member_key).isNotNull()).select(F.col(member_key).alias("_mk")).distinct()
    return df.join(m, df[key] == m["_mk"], "left").withColumn(out, F.col("_mk").isNotNull()).drop("_mk")


def left_merge_fill(left: DataFrame, right: DataFrame, on: str | Sequence[str], fills: Mapping[str, object]) -> DataFrame:
    return left.join(right, on, "left").fillna(dict(fills))


def multi_key_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on several keys; NULL keys never match."""
    return left.join(right, list(keys), "left")


def inner_join_rankings(a: DataFrame, b: DataFrame, on: str = "feature") -> DataFrame:
    return a.join(b, on, "inner")


def key_uniqueness(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once; a look-up needs this to be empty."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def event_window_tag(
    df: DataFrame, windows: DataFrame, place: str, ts: str, w_place="place", w_start="start_ts", w_end="end_ts",
    slot_hours: int = 24,
) -> DataFrame:
    """Rows inside a window of their place, both ends closed, one output row per (row, window).

    Each window is listed in the time slots it touches, so the range test runs behind an equi-join on
    (place, slot) and neither side has to fit in memory.
    """
    step = slot_hours * 3600
    first, last = F.floor(epoch_seconds(w_start) / step), F.floor(epoch_seconds(w_end) / step)
    listed = windows.withColumn("_slot", F.explode(F.sequence(first, last)))
    facts = df.withColumn("_slot_f", F.floor(epoch_seconds(ts) / step))
    hit = (
        (facts[place] == listed[w_place]) & (F.col("_slot_f") == F.col("_slot"))
        & facts[ts].between(listed[w_start], listed[w_end])
    )
    return facts.join(listed, hit, "inner").drop("_slot", "_slot_f")


# ---------------------------------------------------------------- geography


def _cells(lat: str, lon: str, degrees: float) -> tuple[Column, Column]:
    return F.floor((F.col(lat) + 90.0) / degrees), F.floor((F.col(lon) + 180.0) / degrees)


def sites_within(points: DataFrame, sites: DataFrame, point_id: str, site_id: str, km: float) -> DataFrame:
    """All (point, site) pairs at most ``km`` apart, by an equi-join on latitude-longitude cells.

    A point looks into every cell its search circle can touch; the number of longitude cells grows
    towards the poles as the circle covers more degrees there. Longitude wraps around.
    """
    deg = max(km / 111.0, 0.01)
    around = max(1, math.ceil(360.0 / deg))
    p = points.select(F.col(point_id).alias("_pid"), F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    s = sites.select(F.col(site_id).alias("_sid"), F.col("lat").alias("_slat"), F.col("lon").alias("_slon"))
    prow, pcol = _cells("_plat", "_plon", deg)
    srow, scol = _cells("_slat", "_slon", deg)
    # exact reach in longitude: sin(dlon) = sin(d) / cos(lat), everything beyond the pole circle
    ang = km / 6371.0
    ratio = F.lit(math.sin(min(ang, math.pi / 2))) / F.greatest(F.cos(F.radians("_plat")), F.lit(1e-9))
    reach = F.when(F.lit(ang >= math.pi / 2) | (ratio >= 1.0), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))
    span = F.least(F.ceil(reach / deg) + 1, F.lit(around // 2 + 1))
    cells = (
        p.withColumn("_row", F.explode(F.sequence(prow - 2, prow + 2)))
        .withColumn("_c", F.explode(F.array_distinct(F.transform(
            F.sequence(pcol - span, pcol + span), lambda c: F.pmod(c, F.lit(around))))))
    )
    s = s.withColumns({"_srow": srow, "_scol": F.pmod(scol, F.lit(around))})
    pairs = cells.join(s, (cells["_row"] == s["_srow"]) & (cells["_c"] == s["_scol"]), "inner")
    return (
        pairs.withColumn("km", haversine_km("_plat", "_plon", "_slat", "_slon")).where(F.col("km") <= km)
        .select(F.col("_pid").alias(point_id), F.col("_sid").alias(site_id), "km")
    )


def nearest_sites(
    points: DataFrame, sites: DataFrame, point_id: str, site_id: str, k: int, max_km: float, far_km: float | None = None,
    far_k: int | None = None,
) -> DataFrame:
    """Up to ``k`` nearest sites within ``max_km`` (tier ``near``); a point without any gets its nearest one.

    With ``far_km`` the sites ranked after the first ``k`` (up to rank ``far_k``) within that radius follow
    as tier ``far``. All tiers come from the nearest few of each point, so pairs within the radius are never listed.
    """
    last = max(k, far_k or k) if far_km is not None else k
    first, far = F.col("rank") <= k, F.lit(False) if far_km is None else F.col("km") <= far_km
    tier = F.when(first & (F.col("km") <= max_km), "near").when(F.col("rank") == 1, "nearest").when(~first & far, "far")
    return k_nearest(points, sites, point_id, site_id, last).withColumn("tier", tier).where("tier is not null")


PYRAMID = (30.0, 6.0, 1.0, 0.1)  # degrees of the cells' sides, coarse to fine


def nearest_of(points: DataFrame, sites: DataFrame, point_id: str, site_id: str, sides: Sequence[float] = PYRAMID) -> DataFrame:
    """The nearest site of every point, the least ``site_id`` at a tie: (point_id, site_id, km)."""
    return k_nearest(points, sites, point_id, site_id, 1, sides).drop("rank")


def k_nearest(points: DataFrame, sites: DataFrame, point_id: str, site_id: str, k: int, sides: Sequence[float] = PYRAMID) -> DataFrame:
    """The ``k`` nearest sites of every point, lesser ``site_id`` first at a tie: (point_id, site_id, km, rank).

    Points at one place are searched for once, and of the sites at one place the first ``k`` by id are enough. Sites are
    counted in a pyramid of cells. A cell's centre and radius bound the distance to its sites from both sides; a place goes
    down only into cells that may hold a nearer site than ``k`` sites of other cells surely are. Each level is one equi-join
    on the parent cell, on few cells a place, and the last one meets the sites of the cells that are left.
    """
    names = [f"_g{i}" for i in range(len(sides))]
    cell = lambda lat, lon, side: F.concat_ws(":", *_cells(lat, lon, side))
    marked = sites.where("lat is not null and lon is not null").select(F.col(site_id).alias("_sid"), F.col("lat").alias("_slat"), F.col("lon").alias("_slon"))
    marked = marked.withColumn("_i", F.row_number().over(Window.partitionBy("_slat", "_slon").orderBy("_sid"))).where(F.col("_i") <= k).drop("_i")
    marked = marked.withColumns({n: cell("_slat", "_slon", side) for n, side in zip(names, sides)})

    def level(i: int) -> DataFrame:
        keys = names[max(0, i - 1) : i + 1]
        mid = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("held"), *[f(f"_s{c}").alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])
        off = lambda c: F.greatest(F.col(f"max_{c}") - F.col(f"avg_{c}"), F.col(f"avg_{c}") - F.col(f"min_{c}"))
        # along the parallel and then a meridian is no shorter than the straight way
        return mid.select(*keys, "avg_lat", "avg_lon", "held", (F.radians(off("lat") + F.cos(F.radians("avg_lat")) * off("lon")) * EARTH_RADIUS_KM).alias("radius"))

    todo = points.where("lat is not null and lon is not null").select(F.col(point_id).alias("_pid"), F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    left = todo.select("_plat", "_plon").distinct().withColumn("_sure", F.lit(float("inf")))
    within = Window.partitionBy("_plat", "_plon")
    for i in range(len(sides)):
        # the top cells, at most 72, meet every place
        met = (left.join(level(i), names[i - 1]) if i else left.crossJoin(level(0))).withColumn("_d", haversine_km("_plat", "_plon", "avg_lat", "avg_lon"))
        met = met.where(F.col("_d") - F.col("radius") <= F.col("_sure")).withColumn("_high", F.col("_d") + F.col("radius") + 1e-6)
        # the least distance within which whole cells hold k sites
        met = met.withColumn("_held", F.sum("held").over(within.orderBy("_high", names[i]).rowsBetween(Window.unboundedPreceding, 0)))
        met = met.withColumn("_sure", F.least("_sure", F.min(F.when(F.col("_held") >= k, F.col("_high"))).over(within)))
        left = met.where(F.col("_d") - F.col("radius") <= F.col("_sure")).select("_plat", "_plon", "_sure", names[i])
    pairs = left.join(marked.select("_sid", "_slat", "_slon", names[-1]), names[-1]).select("_plat", "_plon", "_sid", haversine_km("_plat", "_plon", "_slat", "_slon").alias("km"))
    found = pairs.withColumn("rank", F.row_number().over(within.orderBy("km", "_sid"))).where(F.col("rank") <= k)
    return todo.join(found, ["_plat", "_plon"]).select(F.col("_pid").alias(point_id), F.col("_sid").alias(site_id), "km", "rank")


def run_distances(stops: DataFrame, run_keys: Sequence[str], stop: str, run_len: int) -> DataFrame:
    """Distances between the stops of one vehicle run.

    Runs come from ``cluster_runs`` and hold at most ``run_len`` stops, so a row meets at most
    ``run_len - 1`` others whatever the size of the site. Each unordered pair appears once.
    """
    a = stops.where(F.col(stop) <= run_len)
    right = [F.col(c).alias(f"_b_{c}") for c in [*run_keys, stop, "lat", "lon"]]
    b = a.select(*right)
    match = reduce(lambda x, y: x & y, [a[c] == b[f"_b_{c}"] for c in run_keys]) & (a[stop] < b[f"_b_{stop}"])
    return a.join(b, match, "inner").select(
        *run_keys, F.col(stop).alias("stop_a"), F.col(f"_b_{stop}").alias("stop_b"),
        haversine_km("lat", "lon", "_b_lat", "_b_lon").alias("km"),
    )


def vehicle_profiles(vehicles: DataFrame, capacity: str, refrigerated: str, rate: str) -> DataFrame:
    """Vehicles that no assignment rule can tell apart, with their number."""
    return vehicles.groupBy(
        F.col(capacity).alias("capacity"), F.col(refrigerated).alias("refrigerated"), F.col(rate).alias("rate")
    ).agg(F.count(F.lit(1)).alias("vehicles"))


def feasible_pairs(routes: DataFrame, profiles: DataFrame, load: str, cold: str, km: str, fee: float = 25.0,
                   band: float = 10.0) -> DataFrame:
    """Cheapest capable profile of every route: capacity covers the load, cold needs refrigeration.

    Cost is ``km * rate / 100 + fee``, so one lowest rate wins whatever the distance. Profiles of a higher
    capacity band are all large enough and are reduced to their lowest rate; those of the route's own band
    are compared one by one. A route meets two table rows, never the whole fleet.
    """
    higher, own = capacity_frontier(profiles, band)
    chilled = F.coalesce(F.col(cold), F.lit(False))
    routes = routes.withColumns({"_band": F.floor(F.col(load) / band).cast("long"), "_cold": chilled})
    joined = routes.join(higher, ["_band", "_cold"], "left").join(own, ["_band", "_cold"], "left")
    fits = F.filter(F.coalesce("_own", F.array().cast("array<struct<capacity:double,rate:double>>")),
                    lambda x: x["capacity"] >= F.col(load))
    rate = F.least("_higher", F.array_min(F.transform(fits, lambda x: x["rate"])))
    return (
        joined.withColumn("rate", rate).withColumn("cost", F.col(km) * F.col("rate") / 100 + fee)
        .drop("_band", "_cold", "_higher", "_own")
    )


def capacity_frontier(profiles: DataFrame, band: float) -> tuple[DataFrame, DataFrame]:
    """Per capacity band and cold need: lowest rate above the band, and the profiles inside it.

    The first table has a row per band up to the largest vehicle; the second groups distinct capacities.
    """
    both, warm = F.array(F.lit(False), F.lit(True)), F.array(F.lit(False))
    need = profiles.select(
        F.col("capacity").cast("double").alias("capacity"), F.col("rate").cast("double").alias("rate"),
        F.explode(F.when(F.col("refrigerated"), both).otherwise(warm)).alias("_cold"),
    ).withColumn("_band", F.floor(F.col("capacity") / band).cast("long"))
    best = need.groupBy("_cold", "_band", "capacity").agg(F.min("rate").alias("rate"))
    top = best.groupBy("_cold", "_band").agg(F.min("rate").alias("rate")).where("_band > 0")
    higher = (
        top.withColumn("_low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_band") - 1)))
        .groupBy(F.col("_low").alias("_band"), "_cold").agg(F.min("rate").alias("_higher"))
    )
    own = best.groupBy("_band", "_cold").agg(F.collect_list(F.struct("capacity", "rate")).alias("_own"))
    return higher, own


def holiday_calendar(
    spark: SparkSession, templates: Sequence[tuple[int, int, str, str]], countries: DataFrame, start: str, end: str,
) -> DataFrame:
    """Template x country x year under the scope rules; impossible dates and dates outside the range drop out.

    ``countries`` has (country, region). The templates are a literal array on each country row.
    """
    y0, y1 = int(start[:4]), int(end[:4])
    literal = F.array(*[
        F.struct(F.lit(m).alias("month"), F.lit(d).alias("day"), F.lit(n).alias("holiday_name"), F.lit(s).alias("scope"))
        for m, d, n, s in templates
    ])
    grid = (
        countries.select("country", "region")
        .withColumn("t", F.explode(literal))
        .withColumn("year", F.explode(F.sequence(F.lit(y0), F.lit(y1))))
        .select("country", "region", "t.*", "year")
    )
    applies = (
        (F.col("scope") == "global") | (F.col("scope") == F.col("country")) | (F.col("scope") == F.col("region"))
        | ((F.col("scope") == "christian") & F.col("region").isin("EMEA", "NA", "LATAM"))
    )
    text = F.format_string("%04d-%02d-%02d", "year", "month", "day")
    shopping = F.col("holiday_name").isin("Black Friday", "Singles Day")
    return (
        grid.where(applies).withColumn("date", F.try_to_date(text, "yyyy-MM-dd"))
        .where((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date")))
        .select(
            "country", "region", "date", "holiday_name",
            F.when(shopping, "shopping_event").otherwise("public_holiday").alias("holiday_type"),
            shopping.alias("is_working_day"),
        )
    )


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(col(key)).where(col(key).isNotNull()).distinct()
