"""Structured Streaming over event tables: an extra, beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of Parquet files; the event time is cast to a timestamp with a zone, as watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by tumbling window; rows later than the watermark are dropped by definition."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return by.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes all that is there now to Parquet, exactly once, and ends."""
    stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
