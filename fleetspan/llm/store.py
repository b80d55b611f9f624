"""Shared-folder results, salted grouping and graph components used by the operators here."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, so that a lost executor repeats nothing before it."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores before them as keep them apart from ``columns``, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a partition as stars: each node with the smallest node that these links reach."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = y
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
            u, v = top(u), top(v)
            if u != v:
                above[max(u, v)] = min(u, v)
    rows = [(x, top(x)) for x in above]
    yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b", edges_per_task: int = 200_000) -> DataFrame:
    """(node, component) for every node of an undirected link table; the component is its smallest node.

    Partitions first reduce their links to stars, so that a node stays at most once per partition; these stars are gathered
    in tasks of about ``edges_per_task`` and reduced again. If that was one task, it is the answer. Otherwise large-star and
    small-star contraction alternate until the links stop changing; each round is linear in the links, whatever the degree
    of a node, and is cut by a checkpoint.
    """
    stars = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").mapInPandas(_forest, "u long, v long"), "stars")
    tasks = 1 + stars.count() // edges_per_task
    edges = stored(stars.coalesce(tasks).mapInPandas(_forest, "u long, v long"), "stars")
    if tasks > 1:
        edges = _contracted(edges, edges_per_task)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _contracted(edges: DataFrame, edges_per_task: int) -> DataFrame:
    # few links need few tasks, and so few shuffle files
    cut = lambda df: (kept := cut_lineage(df)).coalesce(1 + kept.count() // edges_per_task)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every remaining link points from the larger node to the smaller
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        edges = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges
        seen = state
