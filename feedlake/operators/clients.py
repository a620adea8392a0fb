"""Client identity and client sessions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake import constants as C
from feedlake.functions.text import trim_space
from feedlake.operators.cadence import floor_to


def _given(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def client_key() -> Column:
    """16 hex digits from address, agent, language and hashed session cookie; absent parts left out."""
    ip = F.coalesce(
        trim_space(F.substring_index(_given("x_forwarded_for"), ",", 1)), _given("x_real_ip"), F.col("remote_addr")
    )
    word = "[^" + re.escape(C.WHITE_SPACE) + "]+"
    agent = F.nullif(F.lower(F.regexp_extract("user_agent", word, 0)), F.lit(""))
    language = F.lower(trim_space(F.left(_given("accept_language"), F.lit(2))))
    session = F.left(F.sha2(_given("session_id"), 256), F.lit(8))
    parts = F.concat_ws(
        "|", F.concat(F.lit("ip:"), ip), F.concat(F.lit("ua:"), agent),
        F.concat(F.lit("lang:"), language), F.concat(F.lit("sess:"), session),
    )
    return F.left(F.sha2(parts, 256), F.lit(16))


def with_client_id(requests: DataFrame) -> DataFrame:
    return requests.withColumn("client_id", client_key())


def client_sessions(requests: DataFrame, idle_us: int = C.CLIENT_IDLE_US) -> DataFrame:
    """Per client, the spans between idle times of more than ``idle_us``.

    Requests less than one idle time apart always share a session, so they first collapse into slots
    of that length (map-side, whatever a client's traffic); only slots are ordered per client.
    """
    us = F.unix_micros("ts")
    slots = requests.groupBy("client_id", floor_to(us, idle_us).alias("slot")).agg(
        F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count(F.lit(1)).alias("requests")
    )
    order = Window.partitionBy("client_id").orderBy("slot")
    starts = F.coalesce(F.col("first_us") - F.lag("last_us").over(order) > idle_us, F.lit(True))
    marked = slots.withColumn("starts", starts.cast("int"))
    numbered = marked.withColumn(
        "session", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return numbered.groupBy("client_id", "session").agg(
        F.timestamp_micros(F.min("first_us")).alias("session_start"),
        F.timestamp_micros(F.max("last_us")).alias("last_seen"),
        F.timestamp_micros(F.max("last_us") + idle_us).alias("session_end"),
        F.sum("requests").alias("requests"),
    ).drop("session")
