"""Hourly counts of an event stream; an extension beside the batch counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly_stream(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(hour, count) per hour of event time; rows later than ``late`` behind the newest are dropped.

    State is one count for each open hour, so it does not grow with the stream.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("hour"), "count")


def run_once(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Read all that is available now and return the resulting table; for tests and small result tables."""
    writer = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return spark.table(name)
