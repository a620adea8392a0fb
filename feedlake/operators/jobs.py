"""Job lifecycle events to the latest state per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake import constants as C


def event_states(events: DataFrame, *also: str) -> DataFrame:
    """Each lifecycle event as the state of a job that saw only this event.

    States merge by plain aggregates (:func:`merge_aggregates`), so one definition serves the batch
    job, the streaming aggregate and the merge of a micro-batch into a state table.

    ``completed_at`` is set by *every* change after submission, as the service does;
    ``started_at_derived`` is the first ``processing`` event.  The columns ``also`` are kept.
    """
    submitted = F.col("status") == "pending"
    return events.select(
        "job_id", *also,
        F.when(submitted, F.struct("ts", "url")).alias("submission"),
        F.when(F.col("status") == "processing", F.col("ts")).alias("started_at_derived"),
        F.when(~submitted, F.col("ts")).alias("completed_at"),
        F.struct("ts", "step", "status", "error", "items_count", "duration_ms").alias("last"),
    )


def merge_aggregates() -> list[Column]:
    return [
        F.min("submission").alias("submission"),
        F.min("started_at_derived").alias("started_at_derived"),
        F.max("completed_at").alias("completed_at"),
        F.max("last").alias("last"),
    ]


def merge_states(states: DataFrame) -> DataFrame:
    return states.groupBy("job_id").agg(*merge_aggregates())


def shape_state(states: DataFrame) -> DataFrame:
    """Drop jobs that were never submitted and lay the fields out flat."""
    return states.filter("submission is not null").select(
        "job_id", "submission.url", "last.status", F.col("submission.ts").alias("created_at"),
        "started_at_derived", "completed_at", "last.error", "last.items_count", "last.duration_ms",
    )


def job_state(events: DataFrame) -> DataFrame:
    return shape_state(merge_states(event_states(events)))


def lookup_job(state: DataFrame, job_id: str) -> DataFrame:
    """The job's row, or no row for an unknown id."""
    return state.filter(F.col("job_id") == job_id)


def drop_old_jobs(state: DataFrame, now: Column, keep_us: int = C.JOB_TTL_US) -> DataFrame:
    return state.filter(F.unix_micros("created_at") >= F.unix_micros(now) - keep_us)
