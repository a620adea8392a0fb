"""Age statistics and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake import constants as C
from feedlake.functions import dates


def cutoff(now: str, retention_days: int = C.RETENTION_DAYS_DEFAULT) -> Column:
    low, high = C.RETENTION_DAYS_RANGE
    if not low <= retention_days <= high:
        raise ValueError(f"retention_days must be within {low}..{high}")
    return F.timestamp_micros(F.lit(dates.instant_us(now) - retention_days * C.DAY_US))


def survives(before: Column) -> Column:
    """Whether a retention run keeps an item: published at ``before`` or later, or undated."""
    return F.col("pub_ts").isNull() | (F.col("pub_ts") >= before)


def age_buckets(items: DataFrame, now: str) -> DataFrame:
    """Counts by age in one pass: total and four disjoint ranges (future items are in none)."""
    at = dates.instant_us(now)
    day, week, month = (F.timestamp_micros(F.lit(at - d * C.DAY_US)) for d in (1, 7, 30))
    ts, end = F.col("pub_ts"), F.timestamp_micros(F.lit(at))
    counted = items.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if((ts >= day) & (ts < end)).alias("last_24h"),
        F.count_if((ts >= week) & (ts < day)).alias("last_7d"),
        F.count_if((ts >= month) & (ts < week)).alias("last_30d"),
        F.count_if(ts < month).alias("older_30d"),
    )
    return counted.unpivot([], counted.columns, "bucket", "items")
