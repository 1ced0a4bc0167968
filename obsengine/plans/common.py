"""What the query modules share: tables, and events as timed observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000  # microseconds, the unit of `us`


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, read as UTC whatever the session's zone."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with `us`; a user stands for a track, value for a measure."""
    return table(spark, sf_dir, "events").withColumn("us", micros(F.col("ts")))
