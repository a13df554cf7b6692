"""Streams of run events: counts by day and the latest state of each document, as the batch functions give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def daily_counts(stream: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """(day, n) of a stream with event times; days close when the watermark passes them."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", "1 day")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), "n")


def latest_state(stream: DataFrame, by: str, at: str, columns: list[str]) -> DataFrame:
    """The newest row of each key, kept up to date (complete or update mode)."""
    return stream.groupBy(by).agg(F.max_by(F.struct(*columns), F.struct(at, *columns)).alias("last")).select(by, "last.*")


def drop_repeats(stream: DataFrame, key: str, at: str = "ts", late: str = "1 day") -> DataFrame:
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.dropDuplicatesWithinWatermark([key]).drop("_at")
