"""Counters, histograms and gauges rolled up from event logs.

Rows are reduced by label before anything is unfolded: bounds, sliding windows and ratios are laid out
over aggregates, never over raw events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake import constants as C
from feedlake.operators.cadence import floor_to


def labels_text(names: Sequence[str]) -> Column:
    return F.concat_ws(",", *(F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names))


def counter_rollup(events: DataFrame, metric: str, labels: Sequence[str], window: str | None = None) -> DataFrame:
    """Count per label set, and per tumbling window of ``ts`` when one is given."""
    keys = [F.col(n) for n in labels]
    if window:
        keys.append(F.window("ts", window)["start"].alias("window_start"))
    counted = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("value"))
    extra = ["window_start"] if window else []
    return counted.select(F.lit(metric).alias("metric"), labels_text(labels).alias("labels"), *extra, "value")


def service_counters(fetches: DataFrame, jobs: DataFrame, store_ops: DataFrame, http: DataFrame) -> DataFrame:
    """The six counters of the service as one table."""
    read = F.lit("get_feed_items").alias("operation")
    ended = jobs.filter(F.col("status").isin("completed", "failed"))
    parts = [
        counter_rollup(fetches, C.FEED_FETCH_TOTAL, ["url", "status"]),
        counter_rollup(ended, C.JOBS_TOTAL, ["status"]),
        counter_rollup(fetches.filter("status = 'cache_hit'").select(read), C.CACHE_HITS_TOTAL, ["operation"]),
        counter_rollup(fetches.filter("status <> 'cache_hit'").select(read), C.CACHE_MISSES_TOTAL, ["operation"]),
        counter_rollup(store_ops, C.STORE_OPS_TOTAL, ["operation", "status"]),
        counter_rollup(http, C.HTTP_TOTAL, ["method", "endpoint", "status"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hit_ratio(fetches: DataFrame) -> DataFrame:
    hits = F.count_if(F.col("status") == "cache_hit")
    return fetches.agg(F.round(hits / F.count(F.lit(1)), 6).alias("hit_ratio"))


def histogram_rollup(
    events: DataFrame, metric: str, value: str, labels: Sequence[str],
    bounds: Sequence[float] = C.DURATION_BOUNDS, window: str | None = None,
) -> DataFrame:
    """Cumulative ``le`` buckets with sum and count per label set (and per tumbling window of ``ts``);
    negative values are not observed."""
    v = F.col(value)
    keys = [F.col(n) for n in labels]
    extra = []
    if window:
        keys.append(F.window("ts", window)["start"].alias("window_start"))
        extra = ["window_start"]
    sums = events.filter(v >= 0).groupBy(*keys).agg(
        F.sum(v.cast("double")).alias("sum"), F.count(F.lit(1)).alias("count"),
        *(F.count_if(v <= b).alias(f"b{i}") for i, b in enumerate(bounds)),
    )
    steps = F.array(
        *(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("value")) for i, b in enumerate(bounds)),
        F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("value")),
    )
    return sums.select(
        F.lit(metric).alias("metric"), labels_text(labels).alias("labels"), *extra,
        F.round("sum", 6).alias("sum"), "count", F.explode(steps).alias("s"),
    ).select("metric", "labels", *extra, "sum", "count", "s.le", F.col("s.value").alias("bucket"))


def service_histograms(fetches: DataFrame, jobs: DataFrame, store_ops: DataFrame, http: DataFrame) -> DataFrame:
    """The five histograms of the service as one table."""
    ended = jobs.filter(F.col("status").isin("completed", "failed"))
    seconds = ended.withColumn("seconds", F.col("duration_ms") / 1000)
    parts = [
        histogram_rollup(fetches, C.FEED_FETCH_SECONDS, "duration_s", ["url", "status"]),
        histogram_rollup(fetches, C.FEED_ITEMS, "items_count", ["url"], C.ITEM_COUNT_BOUNDS),
        histogram_rollup(seconds, C.JOB_SECONDS, "seconds", ["status"]),
        histogram_rollup(store_ops, C.STORE_OP_SECONDS, "duration_s", ["operation", "status"]),
        histogram_rollup(
            http.withColumn("seconds", F.col("duration_ms") / 1000), C.HTTP_SECONDS, "seconds",
            ["method", "endpoint", "status"],
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gauge_last(samples: DataFrame) -> DataFrame:
    """Last value per gauge; ``samples``: ts, name, value."""
    return samples.groupBy("name").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def running_level(changes: DataFrame, step_us: int = C.MINUTE_US, block_us: int = C.DAY_US) -> DataFrame:
    """Level at the end of each step in which it changed; ``changes``: ts, delta.

    A running total over everything would order all rows in one task.  Changes collapse per step;
    totals then run over the steps of each block, on top of the sum of all earlier blocks.
    """
    us = F.unix_micros("ts")
    steps = changes.groupBy(floor_to(us, step_us).alias("step")).agg(F.sum("delta").alias("delta"))
    steps = steps.withColumn("block", floor_to(F.col("step"), block_us))
    sums = steps.groupBy("block").agg(F.sum("delta").alias("delta"))
    # one row per day: this window is small however much is logged
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("block", F.coalesce(F.sum("delta").over(before), F.lit(0)).alias("base"))
    so_far = Window.partitionBy("block").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = steps.withColumn("inner", F.sum("delta").over(so_far)).join(base, "block")
    return levels.select(
        F.timestamp_micros(F.col("step") + step_us).alias("ts"), (F.col("base") + F.col("inner")).alias("value")
    )


def success_rate(fetches: DataFrame, window_minutes: int = 5, slide_minutes: int = 1) -> DataFrame:
    """Share of successful fetches in percent over sliding windows.

    Events collapse into slots one slide long; each slot then adds to the windows that cover it.
    """
    slide = slide_minutes * C.MINUTE_US
    spans = window_minutes // slide_minutes
    if spans * slide_minutes != window_minutes:
        raise ValueError("the window must be a whole number of slides")
    slots = fetches.groupBy(floor_to(F.unix_micros("ts"), slide).alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "success").alias("good")
    )
    starts = F.array(*(F.col("slot") - i * slide for i in range(spans)))
    windows = slots.select(F.explode(starts).alias("start"), "n", "good").groupBy("start").agg(
        F.sum("n").alias("fetches"), F.sum("good").alias("successes")
    )
    return windows.select(
        F.timestamp_micros("start").alias("window_start"), "fetches",
        F.round(F.col("successes") / F.col("fetches") * 100, 6).alias("success_pct"),
    )


def classify_http_log(log: DataFrame) -> DataFrame:
    """Log level and message by status, and the bodies that are kept (short; responses of failures only)."""
    status = F.col("status")
    request, response = F.octet_length("request_body"), F.octet_length("response_body")
    short = lambda n: (n > 0) & (n < C.LOGGED_BODY_BELOW)
    return log.withColumns({
        "level": F.when(status >= 500, "error").when(status >= 400, "warn").otherwise("info"),
        "message": F.when(status >= 500, C.LOG_SERVER_ERROR)
        .when(status >= 400, C.LOG_CLIENT_ERROR)
        .otherwise(C.LOG_SUCCESS),
        "request_body": F.when(short(request), F.col("request_body")),
        "response_body": F.when((status >= 400) & short(response), F.col("response_body")),
    })
