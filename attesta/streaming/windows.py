"""Windowed counts over events, as a batch or a stream: an extension beyond the knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_time(events: DataFrame) -> DataFrame:
    """Event time as a timestamp: watermarks refuse times without a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def daily(events: DataFrame) -> DataFrame:
    """(day, event_type, n, total); the same plan serves a batch and a stream with a watermark."""
    window = F.window("ts", "1 day")
    out = events.groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).alias("total"))
    return out.select(
        F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).cast("double").alias("total")
    )


def stream(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """The same over a growing folder of parquet files; rows later than `late` are left out."""
    schema = spark.read.parquet(path).schema
    events = with_time(spark.readStream.schema(schema).parquet(path))
    return daily(events.withWatermark("ts", late))
