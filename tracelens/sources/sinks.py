"""Where results go: wide or per-measure CSV, and the log of an experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "dataset string, query int, width int, height int, t_from long, t_to long, time_range string, results_size long, io_count long, time_s double, progressive_s double, processing_s double, query_s double, memory_bytes long"


def wide(points: DataFrame, measures: list[str]) -> DataFrame:
    """One row per timestamp and a column per measure, aligned by time."""
    return points.groupBy(F.col("t").alias("timestamp")).pivot("measure", measures).agg(F.max("v")).orderBy("timestamp")


def write_wide(points: DataFrame, measures: list[str], path: str) -> None:
    wide(points, measures).write.option("header", True).csv(path)


def write_per_measure(points: DataFrame, path: str) -> None:
    """A folder per measure of timestamp,value files."""
    points.select("measure", F.col("t").alias("timestamp"), F.col("v").alias("value")).repartition("measure").sortWithinPartitions("measure", "timestamp").write.partitionBy("measure").option("header", True).csv(path)


def write_log(spark: SparkSession, rows: list[tuple], path: str) -> None:
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").option("header", True).csv(path)
