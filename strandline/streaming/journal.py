"""The usage journal as a stream: JSON lines appended by calls, counted by tool in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "ts timestamp, tool string, ok boolean, ms double"


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def usage(calls: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, tool, calls, failed, ms); works on a stream and on a table alike."""
    by = calls.withWatermark("ts", late).groupBy(F.window("ts", window), "tool") if calls.isStreaming else calls.groupBy(F.window("ts", window), "tool")
    return by.agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.avg("ms"), 3).alias("ms")).select(F.col("window.start").alias("start"), "tool", "calls", "failed", "ms")
