from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from fleetspan.functions import chance, geo, labels
from fleetspan.functions import scalars as S


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_buckets_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 5.0, 5.1, 15.0, 300.0, 301.0, None)], "v double")
    got = [r[0] for r in df.select(S.bucketize("v", [5, 15, 40, 100, 300], unit="km")).collect()]
    assert got == ["<5km", "<5km", "5-15km", "5-15km", "100-300km", ">300km", None]


def test_clip_keeps_null_and_ratio_has_a_floor(spark):
    r = one(spark, a=S.clip(F.lit(None).cast("double"), 0.0, 1.0), b=S.clip(F.lit(9.0), 0.0, 1.0), c=S.safe_ratio(F.lit(1.0), F.lit(0.0), 0.5))
    assert (r.a, r.b, r.c) == (None, 1.0, 2.0)


def test_exact_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(None,)], "v double")
    r = df.agg(S.exact_sum("v").alias("s"), S.exact_avg("v").alias("m")).first()
    assert r.s == 0.0 and r.m is None


def test_nonfinite_and_negative_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (-0.0,)], "v double")
    rows = df.select(S.replace_nonfinite("v").alias("a"), S.tidy_double("v").alias("b")).collect()
    assert [r.a for r in rows][:3] == [0.0, 0.0, 0.0]
    assert rows[0].b is None and math.copysign(1, rows[3].b) == 1


@pytest.mark.parametrize("flags,first,count", [("", None, 0), (None, None, 0), ("a", "a", 1), ("a;b", "a", 2)])
def test_label_lists(spark, flags, first, count):
    c = F.lit(flags).cast("string")
    r = one(spark, first=labels.first_label(c), n=F.size(labels.label_array(c)), added=labels.append_label(c, "z"), has=labels.has_label(c, "b"))
    assert r.first == first and r.n == count and r.added == ";".join(filter(None, [flags, "z"])) and r.has == (count == 2)


def test_geometry(spark):
    z = lambda *v: [F.lit(float(x)) for x in v]
    lat, lon = geo.offset_point(*z(10, 179.9, 100, 90))
    r = one(spark, same=geo.haversine_km(*z(5, 5, 5, 5)), far=geo.haversine_km(*z(0, 0, 0, 180)), north=geo.bearing_deg(*z(0, 0, 10, 0)), west=geo.bearing_deg(*z(0, 0, 0, -10)), lon=lon, back=geo.haversine_km(F.lit(10.0), F.lit(179.9), lat, lon))
    assert r.same == 0 and r.far == pytest.approx(math.pi * 6371.0088) and r.north == 0 and r.west == 270
    assert -180 <= r.lon < -179 and r.back == pytest.approx(100, abs=1e-6)


def test_hash_uniform_is_uniform_and_independent_of_partitions(spark):
    df = spark.range(20_000)
    u = chance.hash_uniform("s", "id")
    a = df.select(u.alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(a[0] - 0.5) < 0.01 and 0 <= a[1] and a[2] < 1
    x = df.select("id", u.alias("u")).orderBy("id").limit(50).collect()
    y = df.repartition(7).select("id", u.alias("u")).orderBy("id").limit(50).collect()
    assert x == y
    pick = df.select(chance.weighted_choice(u, ["a", "b"], [3, 1]).alias("c")).where("c = 'a'").count()
    assert abs(pick / 20_000 - 0.75) < 0.02


def test_sequences_pad_and_cut(spark):
    r = one(spark, s=S.make_sequences(F.array(*[F.lit(float(i)) for i in range(5)]), 2, 3))
    assert r.s == [[0, 1, 2], [3, 4, 0]]
