"""Records that keep arriving: folds and quality by window, each trace once, as structured streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def record_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Parquet record files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(stream: DataFrame, time: str = "recorded_at", key: str = "record_id", late: str = "1 day") -> DataFrame:
    """Each record once, though sent again within `late`; state older than that is let go."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_fold(stream: DataFrame, time: str = "recorded_at", width: str = "10 minutes", late: str = "1 day", keys: tuple[str, ...] = ("line",)) -> DataFrame:
    """(window_start, keys, traces, offset_min, offset_max) per tumbling window; rows later than `late` are left out."""
    off = F.when(F.col("has_offset"), F.col("trace_offset"))
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, late) if stream.isStreaming else timed
    out = timed.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("traces"), F.min(off).alias("offset_min"), F.max(off).alias("offset_max"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "traces", "offset_min", "offset_max")


def append_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True):
    """Writes a stream to Parquet, exactly once through its checkpoint; returns the running query."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
