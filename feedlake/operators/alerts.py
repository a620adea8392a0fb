"""Alert rules over windowed metrics, as episodes that open and close."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake import constants as C


@dataclass(frozen=True)
class AlertRule:
    """A SQL predicate over the columns of a metric window."""

    name: str
    type: str
    severity: str
    title: str
    description: str
    predicate: str
    labels: dict[str, str] = field(default_factory=dict)
    enabled: bool = True

    def __post_init__(self):
        if self.type not in C.ALERT_TYPES or self.severity not in C.ALERT_SEVERITIES:
            raise ValueError(f"unknown alert type or severity in rule {self.name!r}")


def default_rules(
    failure_rate: float = 0.25, queue_load: float = 1.0, store_errors: int = 1, service: str = "feedlake"
) -> list[AlertRule]:
    labels = {"service": service}
    return [
        AlertRule(name, kind, severity, title, text, predicate, labels)
        for (name, title, text), kind, severity, predicate in (
            (C.ALERT_FAILURE_RATE, "high_error_rate", "high", f"failure_rate > {failure_rate}"),
            (C.ALERT_QUEUE_FULL, "queue_full", "medium", f"queue_load >= {queue_load}"),
            (C.ALERT_STORE_ERRORS, "datastore_error", "high", f"store_errors > {store_errors}"),
        )
    ]


UNITS_US = {"second": C.SECOND_US, "minute": C.MINUTE_US, "hour": C.HOUR_US, "day": C.DAY_US}


def window_us(window: str) -> int:
    """Length of a window such as ``5 minutes``, in microseconds."""
    number, _, unit = window.strip().partition(" ")
    unit = unit.strip().lower().removesuffix("s")
    if not number.isdigit() or unit not in UNITS_US:
        raise ValueError(f"not a window length: {window!r}")
    return int(number) * UNITS_US[unit]


def metric_windows(fetches: DataFrame, queue: DataFrame, store_ops: DataFrame, window: str = "1 hour") -> DataFrame:
    """Per tumbling window: feed failure rate, highest queue load and failed store operations."""
    start = F.window("ts", window)["start"].alias("window_start")
    parts = [
        fetches.groupBy(start).agg(
            F.count(F.lit(1)).alias("fetches"), F.count_if(F.col("status") == "failed").alias("failures")
        ),
        queue.groupBy(start).agg(F.max(F.col("depth") / F.col("capacity")).alias("queue_load")),
        store_ops.groupBy(start).agg(F.count_if(F.col("status") == "failed").alias("store_errors")),
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, "window_start", "full")
    joined = joined.fillna(0)
    rate = F.when(F.col("fetches") > 0, F.col("failures") / F.col("fetches")).otherwise(0.0)
    return joined.withColumn("failure_rate", rate)


def judged_windows(windows: DataFrame, rules: Sequence[AlertRule]) -> DataFrame:
    """window_start, type and the alert of the first rule of that type that holds, or null."""
    by_type: dict[str, Column] = {}
    for rule in rules:
        if not rule.enabled:
            continue
        labels = F.create_map(*(F.lit(x) for kv in sorted(rule.labels.items()) for x in kv))
        alert = F.struct(
            F.lit(rule.severity).alias("severity"), F.lit(rule.title).alias("title"),
            F.lit(rule.description).alias("description"), labels.alias("labels"),
        )
        holds = F.expr(rule.predicate)
        held = by_type.get(rule.type)
        by_type[rule.type] = F.when(holds, alert) if held is None else held.when(holds, alert)
    return windows.select(
        "window_start",
        F.explode(F.array(*(
            F.struct(F.lit(t).alias("type"), alert.alias("alert")) for t, alert in by_type.items()
        ))).alias("j"),
    ).select("window_start", "j.*")


def log_level(severity: Column) -> Column:
    return F.when(severity == "high", "warn").when(severity == "critical", "error").otherwise("info")


def alert_episodes(windows: DataFrame, rules: Sequence[AlertRule], window: str = "1 hour") -> DataFrame:
    """One row per alert: opened by the first window where a rule of its type holds, silent while it
    keeps holding, resolved at the end of the first window where it does not (NULL while open).

    ``window`` is the length that ``windows`` were made with.  They are few (one per step), so they, not
    events, are what is ordered here.
    """
    step_us = window_us(window)
    judged = judged_windows(windows, rules)
    latest = windows.agg(F.max("window_start").alias("m")).scalar()
    firing = judged.filter("alert is not null")
    line = Window.partitionBy("type").orderBy("window_start")
    us = F.unix_micros("window_start")
    opens = F.coalesce(us - F.lag(us).over(line) > step_us, F.lit(True)).cast("int")
    numbered = firing.withColumn("opens", opens).withColumn(
        "episode", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    episodes = numbered.groupBy("type", "episode").agg(
        F.min_by("alert", "window_start").alias("alert"), F.min("window_start").alias("first"),
        F.max("window_start").alias("last"), F.count(F.lit(1)).alias("windows"),
    )
    end = lambda c, n: F.timestamp_micros(F.unix_micros(c) + n * step_us)
    started = end("first", 1)
    return episodes.select(
        F.concat("type", F.lit("-"), F.unix_seconds(started).cast("string")).alias("alert_id"),
        "type", "alert.*", started.alias("started_at"),
        F.when(F.col("last") < latest, end("last", 2)).alias("resolved_at"), "windows", log_level(F.col("alert.severity")).alias("log_level"),
    )


def active_alerts(episodes: DataFrame, at: Column) -> DataFrame:
    return episodes.filter((F.col("started_at") <= at) & (F.col("resolved_at").isNull() | (F.col("resolved_at") > at)))
