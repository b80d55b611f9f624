from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from fleetspan.operators.marts import export_sheets, write_sheets
from fleetspan.plans import bind as B
from fleetspan.plans.mart_queries import _cube
from fleetspan.sources import readers as R
from fleetspan.sources import sinks as K


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1, "a", 1.5, None), (2, "b", float("nan"), "x"), (3, None, -0.0, "y")], "order_id long, city string, v double, note string")


def test_parquet_round_trip_and_tidy_reading(spark, small, tmp_path):
    K.write_tables({"t": small}, str(tmp_path))
    df = R.read_table(spark, str(tmp_path), "t", normalise=True)
    assert df.where("v is null").count() == 1 and df.count() == 3
    found, absent = R.read_tables(spark, str(tmp_path), ["t", "nothing"])
    assert list(found) == ["t"] and absent == ["nothing"] and spark.table("t").count() == 3


def test_csv_plain_and_gzip(spark, small, tmp_path):
    K.write_csv(small, str(tmp_path / "t.csv"))
    assert R.read_table(spark, str(tmp_path), "t", "csv", small.schema).count() == 3
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("order_id,city\n1,a\n2,b\n")
    assert R.read_table(spark, str(tmp_path), "z", "csv", "order_id long, city string").count() == 2


def test_json_mart_has_no_nonfinite_values(spark, small, tmp_path):
    K.write_json_mart(small.withColumn("day", F.lit("2024-03-01").cast("date")), str(tmp_path / "j"))
    rows = spark.read.json(str(tmp_path / "j")).orderBy("order_id").collect()
    assert rows[0].day == "2024-03-01" and rows[1].v is None


def test_clustered_layout_sorts_and_keeps_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").withColumnRenamed("o_orderkey", "order_id")
    out = K.clustered_layout(df, partitions=3)
    assert K.layout_keys(df) == ["order_id", "o_orderdate"] and out.count() == df.count() and out.rdd.getNumPartitions() <= 3


def test_ground_truth_folders(spark, tmp_path):
    truth = spark.createDataFrame([("t", "a", "1", "x", "MCAR"), ("t", "b", "2", "y", "MAR")], "table string, column string, row_key string, true_value string, mechanism string")
    K.write_ground_truth(truth, str(tmp_path / "truth"))
    assert (tmp_path / "truth" / "table=t" / "column=a").is_dir()


def test_export_sheets(spark, sf, tmp_path):
    sheets = export_sheets(_cube(spark, sf), {"sites": B.sites(spark, sf)})
    assert set(sheets) == {"summary", "by_domain", "by_region", "by_month", "sites"}
    write_sheets({k: sheets[k] for k in ("summary", "by_region")}, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "by_region")).count() == 5


def test_bucketed_table_joins_without_an_exchange(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    K.write_bucketed(df, "fs_orders_b", "o_custkey", 4)
    a = spark.table("fs_orders_b").groupBy("o_custkey").count()
    assert "Exchange hashpartitioning" not in a._jdf.queryExecution().executedPlan().toString()
    spark.sql("drop table fs_orders_b")


def test_every_key_of_the_layout_skips_files(spark, sf, tmp_path):
    import glob

    import pyarrow.parquet as pq

    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku_id"), F.concat(F.lit("WH-"), F.lpad("l_suppkey", 5, "0")).alias("site_id"), "l_shipdate", "l_quantity")
    keys = ["order_id", "sku_id", "site_id", "l_shipdate"]
    assert K.layout_keys(df) == keys
    plain = df.repartitionByRange(32, *keys).sortWithinPartitions(*keys)
    read = {}
    for name, rows in (("plain", plain), ("curve", K.clustered_layout(df, keys, 32))):
        rows.write.parquet(str(tmp_path / name))
        files = [pq.ParquetFile(f).metadata.row_group(0) for f in glob.glob(str(tmp_path / name / "*.parquet"))]
        for k in range(4):
            spans = [(g.column(k).statistics.min, g.column(k).statistics.max) for g in files]
            low, high = sorted(x[0] for x in spans), sorted(x[1] for x in spans)
            # a filter on a tenth of the column
            values = sorted(r[0] for r in df.select(keys[k]).collect())
            a, b = values[len(values) // 10], values[len(values) // 5]
            read[name, k] = sum(x[0] <= (b.encode() if isinstance(b, str) and isinstance(x[0], bytes) else b) and x[1] >= (a.encode() if isinstance(a, str) and isinstance(x[1], bytes) else a) for x in spans) / len(spans)
        assert spark.read.parquet(str(tmp_path / name)).count() == df.count() and low <= high
    # the first key pays a little, the others gain a lot
    share = {k: round(v, 3) for k, v in read.items()}
    assert all(share["curve", k] <= 0.7 * share["plain", k] for k in (1, 2, 3)) and share["curve", 0] <= 0.6, str(list(share.values()))
    nulls = df.withColumn("sku_id", F.when(F.col("sku_id") % 2 == 0, F.col("sku_id")))
    assert K.clustered_layout(nulls, keys, 4).exceptAll(nulls).count() == 0 and K.clustered_layout(df.limit(0), keys, 4).count() == 0
