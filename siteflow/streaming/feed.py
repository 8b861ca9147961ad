"""Feeding a cube from a stream of events: an extra beside the batch sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sum of values by user cell and tumbling window; rows later than the watermark are dropped."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), (F.col("user_id") % 10).cast("int").alias("c0"), F.expr("cast(user_id div 10 as int)").alias("c1"))
        .agg(F.sum("value").alias("v"))
        .select(F.col("w.start").alias("at"), "c0", "c1", "v")
    )


def as_facts(windows: DataFrame, first: str) -> DataFrame:
    """Facts c0, c1, t, v for `densify`; t counts days from `first`."""
    return windows.select("c0", "c1", F.datediff(F.to_date("at"), F.to_date(F.lit(first))).alias("t"), "v")
