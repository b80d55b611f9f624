"""Streaming twins of four batch operators over an event stream.

The transformations take and return streaming frames. ``run_to_table`` drives a bounded source to its end
and keeps the result as a table in the checkpoint folder, so nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import shared_folder


def event_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream the parquet table ``name`` of a folder, be it one file or a folder of part files.

    A single file is matched by its exact name, so a table whose name only begins alike stays out.
    """
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _as_instant(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need an instant; zone-less clocks are read as UTC (the session zone)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_volume(stream: DataFrame, ts: str, by: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and mean per type and window; a window is final once the watermark has passed its end."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = _as_instant(stream, ts).withWatermark(ts, late).groupBy(w, by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("_s"))
    return out.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), by, "n", (F.col("_s").cast("double") / F.col("n")).alias("mean_value"))


def drop_repeats(stream: DataFrame, keys: Sequence[str], ts: str, within: str = "10 minutes") -> DataFrame:
    """First event of each key; repeats inside the time bound are dropped and state is cleared after it."""
    return _as_instant(stream, ts).withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


def latest_per_key(stream: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Latest record per key, for update mode: state holds one row per key."""
    row = F.max_by(F.struct(*columns), F.struct(*order))
    return stream.where(F.col(key).isNotNull()).groupBy(key).agg(row.alias("_r"), F.max(F.struct(*order)).alias("_o")).select(key, "_r.*", F.col(f"_o.{order[0]}").alias("_at"))


def activity_sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: events closer than ``gap`` belong together."""
    out = _as_instant(stream, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def work_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "stream")


def run_to_table(result: DataFrame, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Process everything available and return the result table.

    Append results are written exactly once by the file sink. In update mode each batch's changed rows
    are written under their batch number (a repeated batch overwrites itself) and the newest per key wins.
    """
    spark = result.sparkSession
    folder = work_folder(spark)
    writer = result.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
    if mode == "append":
        q = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        q = writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")).start()
    q.awaitTermination()
    table = spark.read.schema(result.schema if mode == "append" else StructType([*result.schema.fields, StructField("batch", IntegerType())])).parquet(f"{folder}/out")
    if mode == "append":
        return table
    rest = [c for c in result.columns if c not in keys]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
