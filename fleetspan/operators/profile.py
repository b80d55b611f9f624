"""Table and column profiles, target association and correlation, each in a bounded number of passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

from .aggregates import distinct_counts
from .quantiles import column_quantiles, long_numeric

TIMES = (DateType, TimestampType, TimestampNTZType)


def column_roles(df: DataFrame) -> dict[str, list[str]]:
    """Columns by type: numeric, time, other."""
    roles: dict[str, list[str]] = {"numeric": [], "time": [], "other": []}
    for f in df.schema.fields:
        kind = "numeric" if isinstance(f.dataType, NumericType) else "time" if isinstance(f.dataType, TIMES) else "other"
        roles[kind].append(f.name)
    return roles


def one_row(df: DataFrame) -> Column:
    """All columns of a one-row frame as one scalar struct: evaluated once, usable in any projection."""
    return df.select(F.struct(*df.columns)).scalar()


def table_profile(tables: Mapping[str, DataFrame], keys: Mapping[str, str]) -> DataFrame:
    """Rows, columns, missing share, repeated keys and column kinds of each table."""
    parts = []
    for name, df in tables.items():
        roles, key, cols = column_roles(df), keys[name], df.columns
        missing = [F.count_if(F.col(c).isNull()) for c in cols]
        one = df.agg(
            F.count(F.lit(1)).alias("rows"), reduce(lambda a, b: a + b, missing).alias("_cells"),
            reduce(lambda a, b: a + b, [(m > 0).cast("int") for m in missing]).alias("columns_with_missing"),
        )
        repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("d"))
        parts.append(
            one.select(
                F.lit(name).alias("table"), "rows", F.lit(len(cols)).alias("columns"),
                F.coalesce(F.try_divide(F.col("_cells") * 100.0, F.col("rows") * len(cols)), F.lit(0.0)).alias("missing_cells_pct"),
                "columns_with_missing", repeated.scalar().alias("duplicate_key_rows"),
                F.lit(len(roles["numeric"])).alias("numeric_columns"), F.lit(len(roles["time"])).alias("time_columns"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def missing_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Percent missing per column, only where there is any."""
    cols = list(columns or df.columns)
    one = df.agg(*[(F.count_if(F.col(c).isNull()) * 100.0 / F.count(F.lit(1))).alias(c) for c in cols])
    return one.unpivot([], cols, "feature", "missing_pct").where(F.col("missing_pct") > 0)


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and bias-corrected skewness and kurtosis per column."""
    x = lambda c: F.col(c).cast("double")
    facts = [
        ("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max), ("n_missing", lambda v: F.count_if(v.isNull())),
        ("_g1", F.skewness), ("_g2", F.kurtosis),
    ]
    wide = df.agg(*[f(x(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in facts])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(k) for k, _ in facts]) for i, c in enumerate(columns)])
    g = wide.select(F.explode(rows).alias("r")).select("r.*")
    n = F.col("n").cast("double")
    skew = F.when((n > 2) & (F.col("std") > 0), F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((n > 3) & (F.col("std") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6))
    return g.withColumns({"skew": skew, "kurtosis": kurt}).drop("_g1", "_g2")


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Describe, quartiles, shape and cardinality of the numeric columns."""
    cols = list(columns or column_roles(df)["numeric"])
    quart = column_quantiles(df, cols, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return moments(df, cols).join(quart, "column", "left").join(distinct_counts(df, cols), "column", "left").withColumn(
        "missing_pct", F.col("n_missing") * 100.0 / (F.col("n") + F.col("n_missing"))
    )


def top_values(df: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """Most frequent values per column; ties alphabetical. The rank filter runs before the shuffle too."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    counts = text.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cardinality, missing share, top value and its share per column."""
    total = df.agg(F.count(F.lit(1))).scalar()
    top = top_values(df, columns, 1).select("column", F.col("value").alias("top_value"), F.col("n").alias("_top"))
    miss = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).unpivot([], list(columns), "column", "_miss")
    return (
        distinct_counts(df, columns).join(miss, "column").join(top, "column", "left").withColumn("_total", total)
        .select(
            "column", "n_unique", (F.col("_miss") * 100.0 / F.col("_total")).alias("missing_pct"),
            F.coalesce("top_value", F.lit("")).alias("top_value"),
            (F.coalesce("_top", F.lit(0)) * 100.0 / F.col("_total")).alias("top_share_pct"),
        )
    )


def column_profile(df: DataFrame, table: str) -> DataFrame:
    """Data dictionary: one row per column with what applies to its type."""
    roles = column_roles(df)
    total = df.agg(F.count(F.lit(1))).scalar()
    miss = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "n_missing")
    kinds = F.create_map(*[x for k, cs in roles.items() for c in cs for x in (F.lit(c), F.lit(k))])
    out = miss.withColumn("_t", total).select(
        F.lit(table).alias("table"), "column", F.try_element_at(kinds, F.col("column")).alias("kind"), "n_missing",
        F.try_divide(F.col("n_missing") * 100.0, F.col("_t")).alias("pct_missing"),
    ).join(distinct_counts(df, df.columns), "column", "left")
    if roles["numeric"]:
        num = moments(df, roles["numeric"]).select("column", "mean", "std", "skew", F.col("min").cast("string").alias("_nmin"), F.col("max").cast("string").alias("_nmax"))
        out = out.join(num, "column", "left").join(
            column_quantiles(df, roles["numeric"], {"p25": 0.25, "median": 0.5, "p75": 0.75}), "column", "left")
    rest = roles["time"] + roles["other"]
    if roles["time"]:
        lim = df.agg(*[F.struct(F.min(c).cast("string").alias("lo"), F.max(c).cast("string").alias("hi")).alias(c) for c in roles["time"]])
        times = lim.unpivot([], roles["time"], "column", "_lim").select("column", "_lim.lo", "_lim.hi")
        out = out.join(times, "column", "left")
    else:
        out = out.withColumns({"lo": F.lit(None).cast("string"), "hi": F.lit(None).cast("string")})
    if rest and roles["other"]:
        top = top_values(df, roles["other"], 3).groupBy("column").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), "; ").alias("top_values"))
        out = out.join(top, "column", "left")
    if roles["numeric"]:
        out = out.withColumns({"min": F.coalesce("_nmin", "lo"), "max": F.coalesce("_nmax", "hi")}).drop("_nmin", "_nmax", "lo", "hi")
    return out


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Class counts, shares and imbalance against the rarest class."""
    g = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy()  # over a handful of classes
    return g.withColumns({
        "share_pct": F.col("count") * 100.0 / F.sum("count").over(w),
        "imbalance_ratio": F.max("count").over(w) / F.greatest(F.min("count").over(w), F.lit(1)),
    })


def target_describe(df: DataFrame, target: str) -> DataFrame:
    return moments(df, [target]).join(column_quantiles(df, [target], {"p25": 0.25, "median": 0.5, "p75": 0.75}), "column")


def target_association(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], top_n: int = 12) -> DataFrame:
    """Absolute Pearson correlation (median fill) and spread of level means over the target's deviation."""
    y = F.col(target).cast("double")
    parts = []
    if numeric:
        med = column_quantiles(df, numeric, {"m": 0.5}).agg(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(c) for c in numeric])
        filled = df.withColumn("_med", one_row(med))
        one = filled.agg(*[F.corr(F.coalesce(F.col(c).cast("double"), F.col(f"_med.{c}")), y).alias(c) for c in numeric])
        parts.append(
            one.unpivot([], list(numeric), "feature", "signed").where(F.col("signed").isNotNull() & ~F.isnan("signed"))
            .select("feature", F.lit("numeric").alias("kind"), F.abs("signed").alias("association"), "signed"))
    if categorical:
        text = df.select(y.alias("_y"), *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in categorical])
        means = text.unpivot(["_y"], list(categorical), "feature", "level").groupBy("feature", "level").agg(F.avg("_y").alias("_m"))
        sd = df.agg(F.stddev_pop(y)).scalar()
        parts.append(
            means.groupBy("feature").agg(F.count(F.lit(1)).alias("_levels"), (F.max("_m") - F.min("_m")).alias("_spread"))
            .where(F.col("_levels").between(2, 60)).withColumn("_sd", sd)
            .select("feature", F.lit("categorical").alias("kind"), F.try_divide(F.col("_spread"), F.col("_sd")).alias("association"), F.lit(None).cast("double").alias("signed")))
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(F.col("association").desc(), "feature").limit(top_n)


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle of the correlation matrix in one aggregation pass (columns are few, rows are not)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    x = lambda c: F.col(c).cast("double")
    one = df.agg(*[F.corr(x(a), x(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def high_pairs(df: DataFrame, columns: Sequence[str], level: float = 0.9, k: int = 30) -> DataFrame:
    pairs = correlation_pairs(df, columns).withColumn("abs_corr", F.abs("corr"))
    return pairs.where(F.col("abs_corr") > level).orderBy(F.col("abs_corr").desc(), "feature_a", "feature_b").limit(k)


def widest_columns(df: DataFrame, columns: Sequence[str], n: int) -> list[str]:
    """Names of the columns with the largest deviation; one aggregate row comes to the driver."""
    row = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return sorted(columns, key=lambda c: (-(row[c] or 0.0), c))[:n]


def is_boolean(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, BooleanType)
