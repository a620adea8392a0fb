"""Admission of work by queue load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake import constants as C


def admission(load_depth: str = "depth", capacity: str = "capacity", threshold: float = C.REJECT_THRESHOLD, backpressure: bool = True):
    """reject at the threshold, delay from four fifths of it, admit below or without backpressure."""
    if not backpressure:
        return F.lit("admit")
    load = F.col(load_depth) / F.col(capacity)
    return F.when(load >= threshold, "reject").when(load >= threshold * 0.8, "delay").otherwise("admit")


def queue_admission(samples: DataFrame, threshold: float = C.REJECT_THRESHOLD, backpressure: bool = True) -> DataFrame:
    return samples.withColumn("verdict", admission(threshold=threshold, backpressure=backpressure))


def admission_summary(samples: DataFrame, window: str = "1 hour", **options) -> DataFrame:
    judged = queue_admission(samples, **options)
    return judged.groupBy(F.window("ts", window)["start"].alias("window_start"), "verdict").agg(
        F.count(F.lit(1)).alias("samples"), F.max("depth").alias("max_depth")
    )
