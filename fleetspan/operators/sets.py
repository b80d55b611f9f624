"""Top-k, leaderboards, samples and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chance import hash_uniform
from ..functions.scalars import rate

# Metrics for which a smaller value is better.
LOWER_IS_BETTER = ["rmse", "mae", "median_ae", "max_error", "mape", "log_loss", "brier", "davies_bouldin", "bic", "aic"]


def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """Each task keeps its k best rows, then those are merged."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The rank filter is also applied before the shuffle, so a large group sends k rows per task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.dropna(subset=list(by)).withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def busiest_group(df: DataFrame, site: str, day: str, order: Sequence[str], n: int) -> DataFrame:
    """Rows of the largest (site, day), topped up with the same site's other days to ``n`` rows."""
    work = df.dropna(subset=[site, day])
    sizes = work.groupBy(site, day).agg(F.count(F.lit(1)).alias("_n"))
    best = top_k(sizes, [F.col("_n").desc(), site, day], 1).select(F.struct(site, day).alias("b"))
    chosen = work.withColumn("_best", best.scalar()).where(F.col(site) == F.col(f"_best.{site}"))
    ranked = chosen.withColumn("_other", (F.col(day) != F.col(f"_best.{day}")).cast("int"))
    return top_k(ranked, ["_other", *order], n).drop("_best", "_other")


def worst_groups(df: DataFrame, by: str, min_n: int = 30, k: int = 10) -> DataFrame:
    """Groups with enough orders and the highest late rate, with their late orders above the average."""
    avg_late = df.agg(rate("is_late")).scalar()
    groups = df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("orders"), rate("is_late").alias("late_rate")
    ).where(F.col("orders") >= min_n)
    scored = groups.withColumn("excess_late", F.greatest(F.col("late_rate") - avg_late, F.lit(0.0)) * F.col("orders"))
    return top_k(scored, [F.col("late_rate").desc(), by], k)


def stable_sort(df: DataFrame, order: Sequence[Column | str], unique: Sequence[str]) -> DataFrame:
    """Total order: ties are broken by the row key."""
    return df.orderBy(*order, *unique)


def leaderboard(scores: DataFrame, metric: str, tie: str = "model") -> DataFrame:
    """Best first by the metric's own direction, undefined scores last; adds the rank."""
    by = F.col(metric).asc_nulls_last() if metric in LOWER_IS_BETTER else F.col(metric).desc_nulls_last()
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(by, tie)))


def sample_k(df: DataFrame, key: str, n: int, seed: int = 7, stream: str = "sample") -> DataFrame:
    """A fixed-size sample that does not depend on partitioning."""
    return df.withColumn("_u", hash_uniform(stream, key, seed)).orderBy("_u", key).limit(n).drop("_u")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def except_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).where(F.col(key).isNotNull()).distinct().join(b.select(key).distinct(), key, "left_anti")


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Number of rows that repeat an earlier one, on all columns or on a key."""
    cols = list(columns or df.columns)
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("_n") > 1).alias("repeated_groups"),
    )


def missing_names(found: Mapping, expected: Sequence[str]) -> list[str]:
    return [n for n in expected if n not in found]
