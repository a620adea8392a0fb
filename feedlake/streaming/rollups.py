"""Windowed counters, histograms, rates and alert windows over a stream.

The logs of a service become one stream of observations first, so each roll-up is a single aggregate
however many metrics it holds.  Rows later than ``delay`` behind the newest are dropped by the watermark.
All run in update mode into a change log.  Where no row may be dropped, ``add_counters``,
``add_histograms`` and ``add_fetches`` sum batches instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake import constants as C
from feedlake.operators.metrics import labels_text
from feedlake.streaming.tables import read_changes


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _observed(log: DataFrame, metric: str, labels: list[str], value: Column | None = None) -> DataFrame:
    return log.select("ts", F.lit(metric).alias("metric"), labels_text(labels).alias("labels"), (F.lit(1.0) if value is None else value).cast("double").alias("value"))


def _start(window: str) -> Column:
    return F.window("ts", window).alias("w")


def counter_observations(fetches: DataFrame, jobs: DataFrame, store_ops: DataFrame, http: DataFrame) -> DataFrame:
    """ts, metric, labels, value of everything that the six counters of the service count."""
    read = fetches.withColumn("operation", F.lit("get_feed_items"))
    return _union([
        _observed(fetches, C.FEED_FETCH_TOTAL, ["url", "status"]),
        _observed(jobs.filter(F.col("status").isin("completed", "failed")), C.JOBS_TOTAL, ["status"]),
        _observed(read.filter("status = 'cache_hit'"), C.CACHE_HITS_TOTAL, ["operation"]),
        _observed(read.filter("status <> 'cache_hit'"), C.CACHE_MISSES_TOTAL, ["operation"]),
        _observed(store_ops, C.STORE_OPS_TOTAL, ["operation", "status"]),
        _observed(http, C.HTTP_TOTAL, ["method", "endpoint", "status"]),
    ])


def stream_counters(fetches: DataFrame, jobs: DataFrame, store_ops: DataFrame, http: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """The six counters of the service per label set and window."""
    observed = counter_observations(fetches, jobs, store_ops, http)
    counted = observed.withWatermark("ts", delay).groupBy("metric", "labels", _start(window)).agg(F.count(F.lit(1)).alias("value"))
    return counted.select("metric", "labels", F.col("w.start").alias("window_start"), "value")


LATE = "late bigint, newest timestamp"


def _add(path: str, keys: list[str], sums: list[Column], schema: str, window: tuple[str, ...], delay_us: int) -> Callable[[DataFrame, int], None]:
    """foreachBatch body that drops no row, however late.

    Each batch adds its own ``sums`` by ``keys`` and window to a log, one folder for each batch, overwritten when it is
    replayed; no state and no watermark stand between, and :func:`_added` sums the log.  Rows that a watermark of
    ``delay_us`` would have dropped are counted as late.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = None
        if batch_id > 0:
            log = read_changes(spark, path, spark.createDataFrame([], f"{schema}, {LATE}").schema).where(F.col("batch_id") < batch_id)
            newest = log.agg(F.unix_micros(F.max("newest"))).first()[0]
        late = F.unix_micros("w.end") <= F.lit(newest).cast("bigint") - delay_us
        counted = batch.withColumn("w", F.window("ts", *window)).groupBy(*keys, F.col("w.start").alias("window_start")).agg(
            *sums, F.count_if(late).alias("late"), F.max("ts").alias("newest"))
        counted.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return each


def _added(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    fields = spark.createDataFrame([], schema).schema.names
    by = [*keys, "window_start"]
    log = read_changes(spark, path, spark.createDataFrame([], f"{schema}, {LATE}").schema)
    return log.groupBy(*by).agg(*(F.sum(c).alias(c) for c in fields if c not in by), F.sum("late").alias("late"))


METRIC = ["metric", "labels"]
COUNTERS = "metric string, labels string, window_start timestamp, value bigint"


def add_counters(path: str, window: str = "1 hour", delay_us: int = C.HOUR_US) -> Callable[[DataFrame, int], None]:
    """foreachBatch body over :func:`counter_observations` that drops no row."""
    return _add(path, METRIC, [F.count(F.lit(1)).alias("value")], COUNTERS, (window,), delay_us)


def added_counters(spark: SparkSession, path: str) -> DataFrame:
    """metric, labels, window_start, value and the rows of it that came late."""
    return _added(spark, path, METRIC, COUNTERS)


BOUNDS = {"d": C.DURATION_BOUNDS, "i": C.ITEM_COUNT_BOUNDS}
STEPS = [(f"{k}{i}", b) for k, steps in BOUNDS.items() for i, b in enumerate(steps)]
HISTOGRAMS = f"metric string, labels string, window_start timestamp, sum double, count bigint, {', '.join(f'{c} bigint' for c, _ in STEPS)}"


def _histogram_sums() -> list[Column]:
    return [F.sum("value").alias("sum"), F.count(F.lit(1)).alias("count"), *(F.count_if(F.col("value") <= b).alias(c) for c, b in STEPS)]


def _unfold_steps(sums: DataFrame) -> DataFrame:
    """A row for every bound of each histogram."""

    def steps(k: str) -> Column:
        return F.array(
            *(F.struct(F.lit(str(b)).alias("le"), F.col(f"{k}{i}").alias("bucket")) for i, b in enumerate(BOUNDS[k])),
            F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket")),
        )

    kept = [c for c in sums.columns if c not in {c for c, _ in STEPS}]
    unfolded = F.explode(F.when(F.col("metric") == C.FEED_ITEMS, steps("i")).otherwise(steps("d")))
    return sums.select(*kept, unfolded.alias("s")).select(*kept, "s.le", "s.bucket").withColumn("sum", F.round("sum", 6))


def histogram_observations(fetches: DataFrame, jobs: DataFrame, store_ops: DataFrame, http: DataFrame) -> DataFrame:
    """ts, metric, labels, value of the five histograms of the service; negative values are not observed."""
    seconds = F.col("duration_ms") / 1000
    return _union([
        _observed(fetches, C.FEED_FETCH_SECONDS, ["url", "status"], F.col("duration_s")),
        _observed(fetches, C.FEED_ITEMS, ["url"], F.col("items_count")),
        _observed(jobs.filter(F.col("status").isin("completed", "failed")), C.JOB_SECONDS, ["status"], seconds),
        _observed(store_ops, C.STORE_OP_SECONDS, ["operation", "status"], F.col("duration_s")),
        _observed(http, C.HTTP_SECONDS, ["method", "endpoint", "status"], seconds),
    ]).filter("value >= 0")


def stream_histograms(fetches: DataFrame, jobs: DataFrame, store_ops: DataFrame, http: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """The five histograms of the service per label set and window."""
    observed = histogram_observations(fetches, jobs, store_ops, http)
    sums = observed.withWatermark("ts", delay).groupBy(*METRIC, _start(window)).agg(*_histogram_sums())
    return _unfold_steps(sums.select(*METRIC, F.col("w.start").alias("window_start"), "sum", "count", *(c for c, _ in STEPS)))


def add_histograms(path: str, window: str = "1 day", delay_us: int = C.HOUR_US) -> Callable[[DataFrame, int], None]:
    """foreachBatch body over :func:`histogram_observations` that drops no row."""
    return _add(path, METRIC, _histogram_sums(), HISTOGRAMS, (window,), delay_us)


def added_histograms(spark: SparkSession, path: str) -> DataFrame:
    """metric, labels, window_start, sum, count, late, le, bucket."""
    return _unfold_steps(_added(spark, path, METRIC, HISTOGRAMS))


RATES = "window_start timestamp, fetches bigint, good bigint"


def _rate_sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("fetches"), F.count_if(F.col("status") == "success").alias("good")]


def _success_pct() -> Column:
    return F.round(F.col("good") / F.col("fetches") * 100, 6).alias("success_pct")


def add_fetches(path: str, window: str = "5 minutes", slide: str = "1 minute", delay_us: int = C.HOUR_US) -> Callable[[DataFrame, int], None]:
    """foreachBatch body over the fetch log that drops no row of its rates."""
    return _add(path, [], _rate_sums(), RATES, (window, slide), delay_us)


def added_success_rate(spark: SparkSession, path: str) -> DataFrame:
    """window_start, fetches, success_pct and the fetches that came late."""
    return _added(spark, path, [], RATES).select("window_start", "fetches", _success_pct(), "late")


def stream_success_rate(fetches: DataFrame, window: str = "5 minutes", slide: str = "1 minute", delay: str = "1 hour") -> DataFrame:
    """Share of successful fetches in percent over sliding windows."""
    counted = fetches.withWatermark("ts", delay).groupBy(F.window("ts", window, slide).alias("w")).agg(*_rate_sums())
    return counted.select(F.col("w.start").alias("window_start"), "fetches", _success_pct())


def stream_metric_windows(fetches: DataFrame, queue: DataFrame, store_ops: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Failure rate, queue load and store errors per window: what alert rules are judged on."""
    zero = F.lit(0)

    def row(log: DataFrame, fetched: Column = zero, failed: Column = zero, load: Column = F.lit(0.0), errors: Column = zero) -> DataFrame:
        return log.select("ts", fetched.alias("fetched"), failed.cast("int").alias("failed"), load.alias("load"), errors.cast("int").alias("errors"))

    failed = F.col("status") == "failed"
    observed = _union([
        row(fetches, fetched=F.lit(1), failed=failed), row(queue, load=F.col("depth") / F.col("capacity")), row(store_ops, errors=failed)
    ])
    summed = observed.withWatermark("ts", delay).groupBy(_start(window)).agg(
        F.sum("fetched").alias("fetches"), F.sum("failed").alias("failures"), F.max("load").alias("queue_load"), F.sum("errors").alias("store_errors")
    )
    rate = F.when(F.col("fetches") > 0, F.col("failures") / F.col("fetches")).otherwise(0.0)
    return summed.select(F.col("w.start").alias("window_start"), "fetches", "failures", "queue_load", "store_errors", rate.alias("failure_rate"))
