"""Log entries as a stream: hourly summaries that close by watermark, and entries without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch


def entries(spark: SparkSession, pattern: str, schema: str, delay: str) -> DataFrame:
    """Rows of the Parquet files that match ``pattern``, with ``at`` as event time."""
    return spark.readStream.schema(schema).parquet(pattern).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)


def hours(log: DataFrame) -> DataFrame:
    """Entries, first and last time of every hour and type."""
    g = log.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "first", "last")


def once(log: DataFrame, key: str) -> DataFrame:
    """Entries without repeats of ``key`` inside the watermark's delay; the state is bounded by it."""
    return log.dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame) -> DataFrame:
    """Process all that is there, in append mode into Parquet files, and read them.

    Offsets, state and files lie in the shared folder, so a lost executor or a new start goes on
    where the last finished batch ended.
    """
    spark = stream.sparkSession
    path = scratch(spark)
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
