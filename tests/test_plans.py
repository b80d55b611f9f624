"""Plans of the building blocks with broadcasting off: no second shuffle of the facts, no cartesian product."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from fleetspan.operators import cleaning as C
from fleetspan.operators import ordered as W
from fleetspan.operators.quantiles import exact_quantiles


@pytest.fixture(autouse=True)
def large_tables(spark):
    """Plan as if no table were small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def moved(df, column: str) -> int:
    """Exchanges that carry a column, in the plan without adaptive changes."""
    spark = df.sparkSession
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    return sum(f"{column}#" in m for m in re.findall(r"\(\d+\) Exchange.*?\nInput \[\d+\]: \[([^\]]*)\]", text))


EV = ["ts", "event_id"]


def test_numbered_shuffles_the_facts_once(spark, events):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert moved(W.prior_count(events, ["user_id"], EV, W.time_bucket("ts")), "event_id") == 1
        assert moved(W.lags(events, ["user_id"], EV, W.time_bucket("ts"), "value", (1, 2)), "event_id") == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_ungrouped_quantiles_have_no_cartesian_product(events):
    df = exact_quantiles(events, [], "value", {"a": 0.1, "b": 0.5})
    df.collect()
    assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_wide_columns_are_coded(spark):
    df = spark.range(6000).select(F.concat(F.lit("ORD-"), F.col("id").cast("string")).alias("code"), (F.col("id") % 40).cast("string").alias("zone"), (F.col("id") % 3).cast("string").alias("kind"))
    for encoding in ("ordinal", "onehot"):
        out, meta = C.clean_table(df, [], encoding=encoding)
        assert not [f.name for f in out.schema.fields if f.dataType.simpleString() == "string"]
        assert out.agg(F.countDistinct("code"), F.min("code"), F.max("code"), F.countDistinct("zone")).first() == (6000, 0, 5999, 40)
        again = C.replay(df.limit(10).union(spark.createDataFrame([("new", "0", "0")], df.schema)), C.load_meta(C.save_meta(meta)))
        assert again.where("code = -1").count() == 1 and again.count() == 11
