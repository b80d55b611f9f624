"""Which sites to open: greedy choice over bounds by cells, so that zones never meet all sites.

Serving a zone costs demand x kilometres x a rate. Zones are counted by cells of a grid; by the triangle inequality the
distance from a site to a cell's centre bounds its distance to every zone of the cell, and so the total that the site would
give from below and above. A coarse grid drops most sites, a finer one most of the rest. The survivors are measured exactly,
a batch in one pass over the zones, those with the least bounds first, until the best total is below all other bounds.
Totals measured in earlier rounds bound later gains as well, since a site's gain only shrinks as others open.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM, haversine_km
from ..session import cut_lineage

FINE, COARSE = 4.0, 24.0  # degrees of a cell's sides; at most 4,050 fine cells, whatever the number of zones
BATCH, MOST = 64, 512  # sites measured in one pass, at first and at most: each pass that settles nothing doubles it
BLOCK = 1024  # points or sites that meet at once


def _km(lat1, lon1, lat2, lon2) -> np.ndarray:
    p, q = np.radians(lat1), np.radians(lat2)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def _cells(zones: DataFrame, side: float) -> np.ndarray:
    """One line a cell: centre, radius, demand, demand x distance so far, and least and largest distance so far.

    The centre is the mean of the cell's zones, so zones at one place have radius 0. The radius adds the ways along the
    centre's parallel and along a meridian, which is no less than the distance.
    """
    cell = [F.floor(F.col(c) / side).alias(f"c_{c}") for c in ("lat", "lon")]
    reach = [f(c).alias(f"{k}_{c}") for c in ("lat", "lon") for k, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    got = zones.groupBy(*cell).agg(*reach, F.sum("demand").alias("d"), F.sum(F.col("demand") * F.col("near")).alias("dn"), F.min("near").alias("low"), F.max("near").alias("high")).toArrow()
    if not got.num_rows:
        return np.empty((0, 7))
    lat, lat0, lat1, lon, lon0, lon1, *rest = (np.asarray(got.column(c).to_pylist(), float) for c in got.column_names[2:])
    along = lambda x, lo, hi: np.radians(np.maximum(hi - x, x - lo).clip(0)) * EARTH_RADIUS_KM
    return np.column_stack([lat, lon, along(lat, lat0, lat1) + np.cos(np.radians(lat)) * along(lon, lon0, lon1), *rest])


def _coarser(cells: np.ndarray, side: float) -> np.ndarray:
    """The cells of a coarser grid from those of a finer one."""
    centres, which = np.unique((np.floor(cells[:, :2] / side) + 0.5) * side, axis=0, return_inverse=True)
    out = np.zeros((len(centres), 7))
    out[:, :2] = centres
    reach = _km(cells[:, 0], cells[:, 1], *centres[which.ravel()].T) + cells[:, 2] if len(cells) else np.empty(0)
    np.maximum.at(out[:, 2], which, reach)
    for c in (3, 4):
        np.add.at(out[:, c], which, cells[:, c])
    out[:, 5] = np.inf
    np.minimum.at(out[:, 5], which, cells[:, 5])
    np.maximum.at(out[:, 6], which, cells[:, 6])
    return out


def _bounds(sites: DataFrame, cells: np.ndarray, per_km: float) -> DataFrame:
    """``sites`` with the least and the largest total they may give, ``low`` and ``high``; in cells x sites steps, one row a site."""
    held = sites.sparkSession.sparkContext.broadcast(cells)  # a grid's cells, at most 4,050 lines

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, lon, r, d, dn, least, most = held.value.T
        first = not np.isfinite(dn).all()  # nothing is open yet
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                x, y, fixed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon", "fixed"))
                km = _km(lat, lon, x[:, None], y[:, None])
                near = np.maximum(km - r, 0)
                if first:
                    low, high = near @ d, (km + r) @ d
                else:
                    # a zone pays the lesser of the distance so far and that to the site
                    low = np.maximum(dn - d * np.maximum(most - near, 0), d * np.minimum(least, near)).sum(1)
                    high = np.minimum(dn, d * (km + r)).sum(1)
                # the figures are sums of many terms, so the bounds leave room for rounding
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low * per_km * (1 - 1e-9) + fixed), pa.array(high * per_km * (1 + 1e-9) + fixed)], schema=pa.schema([*batch.schema, ("low", pa.float64()), ("high", pa.float64())]))

    plain = sites.select("site_id", "lat", "lon", "fixed")
    return plain.mapInArrow(bound, f"site_id {plain.schema['site_id'].dataType.simpleString()}, lat double, lon double, fixed double, low double, high double")


def _measured(zones: DataFrame, batch: Sequence, per_km: float) -> dict:
    """The exact service cost of the sites of a batch, from one pass over the zones and one row a site and task."""
    lat, lon = np.array([r["lat"] for r in batch]), np.array([r["lon"] for r in batch])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(lat))
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK):
                b = whole.slice(a, BLOCK)
                x, y, demand, near = (b.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("lat", "lon", "demand", "near"))
                sums += (demand * np.minimum(_km(x, y, lat, lon), near) * per_km).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lat))), pa.array(sums)], names=["i", "cost"])

    got = zones.select("lat", "lon", "demand", "near").mapInArrow(totals, "i long, cost double").groupBy("i").agg(F.sum("cost").alias("cost")).collect()
    costs = {r["i"]: r["cost"] for r in got}
    return {r["site_id"]: costs.get(i, 0.0) for i, r in enumerate(batch)}


def greedy_sites(zones: DataFrame, sites: DataFrame, max_open: int = 5, per_km: float = 0.02) -> DataFrame:
    """Open one site per round, always the one with the lowest resulting total, until ``max_open`` are open.

    ``zones``: zone_id, lat, lon, demand; ``sites``: site_id, lat, lon, fixed_cost. The total is the service cost of all zones,
    each from its nearest open site, and a thousandth of the open sites' fixed costs; the least site_id wins a tie. Returns
    site_id, round, total_cost. Zones and sites without a place, and zones without demand, are passed over.
    """
    places = ["lat", "lon"]
    zones = zones.select(*[F.col(c).cast("double").alias(c) for c in (*places, "demand")]).dropna(subset=[*places, "demand"])
    sites = sites.dropna(subset=places).select("site_id", *[F.col(c).cast("double").alias(c) for c in places], (F.coalesce("fixed_cost", F.lit(0.0)) / 1000).alias("fixed"))
    # zones at one place cost the same a unit of demand; of the sites at one place only the cheapest few can ever open
    zones = zones.groupBy(*places).agg(F.sum("demand").alias("demand"))
    by_cost = Window.partitionBy(*places).orderBy("fixed", "site_id")
    sites = sites.withColumn("_i", F.row_number().over(by_cost)).where(F.col("_i") <= max_open).drop("_i")
    base, sites = cut_lineage(zones), cut_lineage(sites)
    opened: list[tuple] = []
    places_open: list = []
    fixed, before = 0.0, np.inf
    gains: dict = {}  # of the sites measured so far, at the time: bounds of what they can save now
    for rnd in range(max_open):
        rest = sites.where(~F.col("site_id").isin([s for s, *_ in opened])) if opened else sites
        # the few open sites are part of the expression, so the zones are read as they were stored
        zones = base.withColumn("near", F.least(F.lit(float("inf")), F.lit(float("inf")), *[haversine_km("lat", "lon", F.lit(r["lat"]), F.lit(r["lon"])) for r in places_open]))
        fine = _cells(zones, FINE)
        rough = _bounds(rest, _coarser(fine, COARSE), per_km)
        most = rough.agg(F.min("high")).first()[0]
        if most is None:
            break
        alive = _bounds(rough.where(F.col("low") <= most).drop("low", "high"), fine, per_km).persist()
        most = alive.agg(F.min("high")).first()[0]
        todo = alive.where(F.col("low") <= most)
        best, last, size = None, None, BATCH
        while True:
            # in order of bounds, a batch a time; the driver never sees more
            after = todo if last is None else todo.where((F.col("low") > last[0]) | (F.col("low") == last[0]) & (F.col("site_id") > last[1]))
            if best is not None:
                after = after.where(F.col("low") <= best[0])
            batch = after.orderBy("low", "site_id").limit(size).collect()
            if not batch:
                break
            size = min(2 * size, MOST)
            last = (batch[-1]["low"], batch[-1]["site_id"])
            # what a site saved when it was last measured is the most that it can save now
            may = lambda r: best is None or r["site_id"] not in gains or before - gains[r["site_id"]] + r["fixed"] <= best[0] + 1e-9 * abs(best[0])
            asked = {r["site_id"]: r for r in batch if may(r)}
            for site, cost in (_measured(zones, list(asked.values()), per_km) if asked else {}).items():
                if opened:
                    gains[site] = before - cost
                offer = (cost + asked[site]["fixed"], site, cost, asked[site])
                if best is None or offer[:2] < best[:2]:
                    best = offer
        total, site, before, row = best
        opened.append((site, rnd + 1, total + fixed))
        fixed += row["fixed"]
        places_open.append(row)
        alive.unpersist()
    kind = sites.schema["site_id"].dataType.simpleString()
    return sites.sparkSession.createDataFrame(opened, f"site_id {kind}, round int, total_cost double")


def nearest_open_site(zones: DataFrame, sites: DataFrame, opened: DataFrame, per_km: float = 0.02) -> DataFrame:
    """Each zone takes its cheapest open site, the least site_id at a tie: zone_id, site_id, km, demand, cost.

    The open sites, as many as were allowed to open, travel as one array; zones are neither shuffled nor multiplied.
    """
    few = sites.join(opened.select("site_id"), "site_id", "left_semi").agg(F.array_sort(F.collect_list(F.struct("site_id", "lat", "lon"))).alias("s")).scalar()
    z = zones.select("zone_id", "lat", "lon", "demand", few.alias("_open"))

    def offer(s):
        km = haversine_km("lat", "lon", s["lat"], s["lon"])
        return F.struct((km * F.col("demand") * per_km).alias("cost"), s["site_id"].alias("site_id"), km.alias("km"))

    best = z.withColumn("_b", F.array_min(F.transform("_open", offer)))
    return best.where("_b is not null").select("zone_id", "_b.site_id", "_b.km", "demand", "_b.cost")


def service_totals(zones: DataFrame, sites: DataFrame, per_km: float = 0.02) -> DataFrame:
    """What each site would cost if it served every zone: site_id, zones, cost, avg_km.

    A total over all zones for every site takes a distance a pair; zones at one place are counted once, and blocks of places
    meet blocks of sites, so that the rows are pairs of blocks and each task holds one such pair.
    """
    places = zones.dropna(subset=["lat", "lon"]).groupBy("lat", "lon").agg(F.sum("demand").alias("demand"), F.count(F.lit(1)).alias("n"))
    size = lambda df: max(1, -(-df.count() // BLOCK))
    places, sites = cut_lineage(places), cut_lineage(sites.select("site_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).dropna(subset=["lat", "lon"]))
    parts, blocks = size(places), size(sites)
    packed = places.groupBy(F.pmod(F.xxhash64("lat", "lon"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("lat", "lon", "demand", F.col("n").cast("double"))).alias("z"))
    others = sites.groupBy(F.pmod(F.xxhash64("site_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("site_id", "lat", "lon")).alias("s"))
    pairs = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(others, "block")
    kind = sites.schema["site_id"].dataType

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z, s in zip(b.column("z"), b.column("s")):
                z, s = z.values, s.values
                lat, lon, demand, n = (z.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                km = _km(s.field(1).to_numpy(zero_copy_only=False)[:, None], s.field(2).to_numpy(zero_copy_only=False)[:, None], lat, lon)
                yield pa.RecordBatch.from_arrays([s.field(0), pa.array(np.full(len(s), int(n.sum()))), pa.array((km * demand * per_km).sum(1)), pa.array((km * n).sum(1))], names=["site_id", "zones", "cost", "km"])

    spread = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = spread.select("z", "s").mapInArrow(met, f"site_id {kind.simpleString()}, zones long, cost double, km double").groupBy("site_id").agg(F.sum("zones").alias("zones"), F.sum("cost").alias("cost"), F.sum("km").alias("_km"))
    return sums.select("site_id", "zones", "cost", (F.col("_km") / F.col("zones")).alias("avg_km"))
