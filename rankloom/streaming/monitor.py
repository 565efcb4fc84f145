"""Windowed latency and error counts over the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.schema import LOG_RECORD


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON log lines as a stream."""
    return spark.readStream.schema(LOG_RECORD).json(path)


def windowed(
    log: DataFrame, size: str = "1 minute", lateness: str = "5 minutes", by: str = "path"
) -> DataFrame:
    """Requests, mean and largest latency, 95th percentile (sketch) and server errors per
    window. Works on a stream (late rows beyond the watermark are dropped) and on a table."""
    source = log.withWatermark("time", lateness) if log.isStreaming else log
    return (
        source.groupBy(F.window("time", size).alias("w"), by)
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.avg("latency_ms").alias("mean_ms"),
            F.max("latency_ms").alias("max_ms"),
            F.percentile_approx("latency_ms", 0.95).alias("p95_ms"),
            F.count(F.when(F.col("status_code") >= 500, 1)).alias("errors"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            by,
            "requests",
            "mean_ms",
            "max_ms",
            "p95_ms",
            "errors",
        )
    )
