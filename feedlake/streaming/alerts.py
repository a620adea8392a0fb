"""Running alerts: what opens and resolves, told once, from a stream of closed metric windows.

A window aggregate in append mode gives out each window once, when the watermark has closed it.  A batch
of them is judged against the alerts that are open; what opens or resolves goes to an outbox, one folder
for each batch, and the open alerts are the next version of a small state (a row for each alert type at
most).  Nothing already judged is looked at again.  A replayed batch starts from the version before it and
overwrites its own folder with the same rows, so whoever reads the outbox by a stream of its own is told
of each event once.

An alert that is resolved and holds again is a new one.  A window of which a rule says nothing
(a gap in the log) resolves, as a window in which it doesn't hold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.operators.alerts import AlertRule, judged_windows, log_level, window_us
from feedlake.streaming.tables import newest_version, read_changes, read_version, version_path

ALERT = "struct<severity:string,title:string,description:string,labels:map<string,string>>"
OPEN = f"type string, alert {ALERT}, first timestamp, last timestamp, windows bigint, judged timestamp"
EVENT = f"kind string, alert_id string, type string, alert {ALERT}, started_at timestamp, resolved_at timestamp, windows bigint, log_level string"


def watch(outbox: str, state: str, rules: Sequence[AlertRule], window: str = "1 hour") -> Callable[[DataFrame, int], None]:
    """foreachBatch body over closed windows (window_start and the columns of the rules)."""
    step = window_us(window)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        open_before = read_version(spark, state, batch_id - 1, OPEN)
        judged = judged_windows(batch, rules).persist()
        try:
            newest = judged.agg(F.max("window_start").alias("m")).first().m
            before = open_before.agg(F.max("judged").alias("m")).first().m
            judged_upto = max((t for t in (newest, before) if t is not None), default=None)
            # an open alert is one firing stretch that ends at its last window
            line = Window.partitionBy("type").orderBy("last")
            firing = judged.where("alert is not null").select(
                "type", "alert", F.col("window_start").alias("first"), F.col("window_start").alias("last"), F.lit(1).cast("bigint").alias("windows"), F.lit(False).alias("known"))
            kept = open_before.where("alert is not null").select("type", "alert", "first", "last", "windows", F.lit(True).alias("known"))
            gap = F.unix_micros("first") - F.lag(F.unix_micros("last")).over(line) > step
            numbered = kept.unionByName(firing).withColumn("opens", F.coalesce(gap, F.lit(True)).cast("int")).withColumn(
                "nth", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            runs = numbered.groupBy("type", "nth").agg(
                F.min_by("alert", "first").alias("alert"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("windows").alias("windows"), F.max("known").alias("known"))
            over = F.col("last") < F.lit(judged_upto)
            end = lambda c, n: F.timestamp_micros(F.unix_micros(c) + n * step)
            started = end("first", 1)
            told = runs.select(
                F.explode(F.array_compact(F.array(F.when(~F.col("known"), "opened"), F.when(over, "resolved")))).alias("kind"),
                F.concat("type", F.lit("-"), F.unix_seconds(started).cast("string")).alias("alert_id"), "type", "alert", started.alias("started_at"),
                end("last", 2).alias("resolved_at"), "windows", log_level(F.col("alert.severity")).alias("log_level"),
            ).withColumn("resolved_at", F.when(F.col("kind") == "resolved", F.col("resolved_at")))
            told.coalesce(1).write.mode("overwrite").parquet(f"{outbox}/batch_id={batch_id}")
            still = runs.where(~over).select("type", "alert", "first", "last", "windows", F.lit(judged_upto).cast("timestamp").alias("judged"))
            clock = spark.createDataFrame([(None, None, None, None, None, judged_upto)], OPEN)
            still.unionByName(clock).coalesce(1).write.mode("overwrite").parquet(version_path(state, batch_id))
        finally:
            judged.unpersist()

    return each


def told_alerts(spark: SparkSession, outbox: str) -> DataFrame:
    """All events of the outbox, with the batch that told them."""
    return read_changes(spark, outbox, spark.createDataFrame([], EVENT).schema)


def episodes_told(spark: SparkSession, outbox: str, state: str | None = None, window: str = "1 hour") -> DataFrame:
    """One row per alert, in the shape of :func:`feedlake.operators.alerts.alert_episodes`.

    Nothing is told while an alert keeps holding, so the windows of an open one are those in the ``state`` of the
    watch; without it they are counted up to when it was told.
    """
    rows = told_alerts(spark, outbox)
    last = F.max_by(F.struct("alert", "started_at", "resolved_at", "windows", "log_level"), F.struct((F.col("kind") == "resolved").alias("r"), "batch_id")).alias("e")
    found = rows.groupBy("alert_id", "type").agg(last).select("alert_id", "type", "e.*")
    if state is not None:
        held = read_version(spark, state, newest_version(spark, state), OPEN).where("alert is not null")
        started = F.timestamp_micros(F.unix_micros("first") + window_us(window))
        # a state of few rows, one for a type
        held = held.select("type", started.alias("started_at"), F.col("windows").alias("held"))
        windows = F.when(F.col("resolved_at").isNull(), F.greatest("windows", "held")).otherwise(F.col("windows"))
        found = found.join(F.broadcast(held), ["type", "started_at"], "left").withColumn("windows", windows)
    return found.select("alert_id", "type", "alert.*", "started_at", "resolved_at", "windows", "log_level")


def notify(spark: SparkSession, outbox: str, checkpoint: str, tell: Callable[[list], None], once: bool = True):
    """Stream the outbox to a notifier: ``tell`` gets the events of a batch as rows, few by their nature.

    The stream's own checkpoint remembers which folders were told.
    """
    events = spark.readStream.schema(EVENT).parquet(outbox)
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: tell(batch.orderBy("started_at", "kind", "alert_id").collect()))
    return (writer.trigger(availableNow=True) if once else writer).start()
