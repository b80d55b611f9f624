"""Writing result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, TimestampNTZType, TimestampType


def write_parquet(df: DataFrame, path: str, codec: str = "snappy", rows_per_file: int = 5_000_000,
                  partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("compression", codec).option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_tables(tables: dict[str, DataFrame], folder: str, codec: str = "snappy") -> None:
    """One folder per result table."""
    for name, df in tables.items():
        write_parquet(df, f"{folder}/{name}.parquet", codec)


def write_csv(df: DataFrame, path: str, gzip: bool = False, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("header", True)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def write_database(df: DataFrame, url: str, name: str, batch: int = 1000, mode: str = "overwrite", **options: str):
    df.write.mode(mode).option("batchsize", batch).options(**options).jdbc(url, name)


def json_ready(df: DataFrame, digits: int = 4) -> DataFrame:
    """NaN and infinities become NULL, times become ISO days, floating values are rounded for display."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), F.round(c, digits))
        elif isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


def write_json_mart(df: DataFrame, path: str, digits: int = 4, mode: str = "overwrite") -> None:
    json_ready(df, digits).write.mode(mode).json(path)


def layout_keys(df: DataFrame) -> list[str]:
    """Columns readers filter on: identifiers and times, in table order."""
    times = (DateType, TimestampType, TimestampNTZType)
    return [f.name for f in df.schema.fields if f.name.endswith("_id") or isinstance(f.dataType, times)]


CURVE_BITS, CUT_SAMPLE = 6, 20_000  # bits of a column's place on the curve at most; values drawn to find where to cut


def with_curve(df: DataFrame, keys: Sequence[str], name: str, seed: int = 42) -> DataFrame:
    """``df`` with a row's place on a curve through the space of ``keys``: the bits of the columns' ranks in turn, highest first.

    A column's rank is the number of cut values that it has reached. Cuts are evenly spaced values of about ``CUT_SAMPLE``
    rows drawn by hash; they only shape the layout, no row depends on them. Any orderable type will do; null comes first.
    """
    bits = max(1, min(CURVE_BITS, 60 // len(keys)))
    n = max(df.count(), 1)
    drawn = df.select(*keys).where(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000)) < F.lit(min(1.0, CUT_SAMPLE / n)) * 1_000_000)
    values = drawn.agg(*[F.array_sort(F.collect_list(F.col(f"`{k}`"))).alias(f"c{i}") for i, k in enumerate(keys)])
    parts = 2**bits
    even = lambda c: F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get(c, F.floor(F.size(c) * i / parts).cast("int")))
    cuts = values.select(F.struct(*[even(F.col(f"c{i}")).alias(f"c{i}") for i in range(len(keys))])).scalar()
    reached = lambda k: lambda s, c: s + F.when(F.col(f"`{k}`") >= c, 1).otherwise(0)
    ranks = F.array(*[F.aggregate(F.col(f"{name}.c{i}"), F.lit(0), reached(k)) for i, k in enumerate(keys)])
    place = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for i in range(len(keys)):
            place = place * 2 + F.shiftright(F.col(name)[i], bit).bitwiseAND(1)
    return df.withColumn(name, cuts).withColumn(name, ranks).withColumn(name, place)


def clustered_layout(df: DataFrame, keys: Sequence[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Lay rows out so that parquet statistics stand in for an index on each of ``keys``, not on the first alone.

    One key: range partitions, sorted. Several: the same along a curve through all of them, so that a file covers a narrow
    range of every key and a range filter on any of them skips files. Range bounds are sampled, so a frequent value is
    spread by the other keys.
    """
    keys = list(keys or layout_keys(df))
    if not keys:
        return df
    order, out = keys, df
    if len(keys) > 1:
        name = next(n for n in ("_curve" + "_" * i for i in range(len(df.columns) + 1)) if n not in df.columns)
        out, order = with_curve(df, keys, name), [name, *keys]
    ranged = out.repartitionByRange(partitions, *order) if partitions else out.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).select(*df.columns)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, sort: Sequence[str] = (), mode="overwrite"):
    """A bucketed table: later joins on ``key`` need no exchange."""
    writer = df.write.mode(mode).bucketBy(buckets, key)
    (writer.sortBy(*sort) if sort else writer).saveAsTable(table)


def write_ground_truth(truth: DataFrame, path: str, mode: str = "overwrite") -> None:
    """True values of masked cells, one folder per (table, column)."""
    truth.write.mode(mode).partitionBy("table", "column").parquet(path)
