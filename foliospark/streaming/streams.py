"""The row-level columns over streams, and windowed counts with watermarks.

Row operators are stateless: a streaming DataFrame goes through ``Bag`` or the column functions as it is.
Only aggregates need a watermark; event times without a zone are cast first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A folder of Parquet files (or the one file of a path) as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    single = name.endswith(".parquet") and not spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).select("path").limit(1).isEmpty()
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return r.option("pathGlobFilter", name).parquet(folder) if single else r.parquet(path)


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling (or sliding) window and keys; rows later than the watermark are left out."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return e.groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def session_counts(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by session: a session ends after a gap without events of its keys."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return e.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """First row of each key within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_once(df: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, with a checkpoint beside the result, and stop."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def for_each(df: DataFrame, use: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    q = df.writeStream.outputMode(mode).foreachBatch(use).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_complete(df: DataFrame, path: str) -> StreamingQuery:
    """Process what is there and write the whole aggregate of the last batch."""
    return for_each(df, lambda b, _: b.write.mode("overwrite").parquet(path), f"{path}-checkpoint", "complete")
