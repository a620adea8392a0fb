"""Client sessions over a stream of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake import constants as C


def stream_sessions(requests: DataFrame, idle_us: int = C.CLIENT_IDLE_US, delay: str = "1 minute") -> DataFrame:
    """Closed client sessions (append mode).  ``session_window`` ends a session at a gap equal to its
    length, the limit here is *more than* the idle time, hence one microsecond on top."""
    gap = F.session_window("ts", f"{idle_us + 1} microseconds")
    return (
        requests.withWatermark("ts", delay).groupBy("client_id", gap.alias("w"))
        .agg(F.min("ts").alias("session_start"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("requests"))
        .select(
            "client_id", "session_start", "last_seen",
            F.timestamp_micros(F.unix_micros("last_seen") + idle_us).alias("session_end"), "requests",
        )
    )
