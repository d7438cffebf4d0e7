"""Min/max groups kept up to date by Structured Streaming.  An addition of ours: batch sources have no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_stream(points: DataFrame, width_ms: int, late: str = "1 hour") -> DataFrame:
    """Groups of a stream with columns measure, ts (timestamp) and v; a group is final once the watermark passes it."""
    timed = points.filter("v is not null and not isnan(v)").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    groups = timed.groupBy("measure", F.window("ts", f"{width_ms} milliseconds")).agg(F.count("*").alias("cnt"), F.sum("v").alias("sum_v"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))
    return groups.select("measure", F.unix_millis("window.start").alias("g_from"), F.unix_millis("window.end").alias("g_to"), "cnt", "sum_v", "min_v", "max_v")


def start(points: DataFrame, width_ms: int, path: str, checkpoint: str, late: str = "1 hour"):
    """Append final groups to a Parquet table."""
    return group_stream(points, width_ms, late).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
