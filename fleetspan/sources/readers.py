"""Loading named tables: parquet, CSV (plain or gzip) and SQL databases."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from ..functions.scalars import tidy_double


def _normalise(df: DataFrame) -> DataFrame:
    """Missing is NULL only: NaN becomes NULL and -0.0 becomes 0.0 in every floating column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[tidy_double(F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def read_table(
    spark: SparkSession, folder: str, name: str, fmt: str = "parquet", schema: StructType | str | None = None,
    normalise: bool = False,
) -> DataFrame:
    """One named table of a folder. ``normalise`` costs predicate pushdown on floating columns."""
    if fmt == "parquet":
        df = spark.read.parquet(f"{folder}/{name}.parquet")
    elif fmt == "csv":
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader
        df = _first_readable(reader.csv, [f"{folder}/{name}.csv", f"{folder}/{name}.csv.gz"])
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return _normalise(df) if normalise else df


def _first_readable(read, paths: Iterable[str]) -> DataFrame:
    missing = None
    for path in paths:
        try:
            return read(path)
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            missing = err
    raise missing


def read_tables(spark: SparkSession, folder: str, names: Iterable[str], fmt: str = "parquet"):
    """Named tables as lazy frames, registered as temporary views, plus the names that are absent."""
    found, absent = {}, []
    for name in names:
        try:
            found[name] = read_table(spark, folder, name, fmt)
            found[name].createOrReplaceTempView(name)
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            absent.append(name)
    return found, absent


def read_database(
    spark: SparkSession, url: str, name: str, key: str | None = None, lower=None, upper=None, partitions: int = 64,
    **options: str,
) -> DataFrame:
    """A database table. With a numeric or time ``key`` and its bounds the read is split over tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key is not None:
        reader = (
            reader.option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    return reader.load()
