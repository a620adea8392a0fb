"""Publication cadence, adaptive refresh times and freshness of fetched feeds.

A feed may hold a third of all rows, so nothing orders a whole feed in one task.  Instants first
collapse into day summaries by plain aggregates; only the summaries (one row per feed and day) are
ordered, and the as-of look-up deals feed and time into ranges of equal size.  Within a day the gaps between consecutive distinct instants add up to last minus first,
which is exact because a gap inside one day is always counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake import constants as C
from feedlake.session import stored


def floor_to(micros: Column, step_us: int) -> Column:
    """Start of the step that holds ``micros``; correct for instants before 1970 too."""
    return micros - F.pmod(micros, F.lit(step_us).cast("bigint"))


def update_interval(items: DataFrame, feed: str = "feed_url", ts: str = "pub_ts") -> DataFrame:
    """Per feed: item count and mean gap between consecutive publications, in microseconds.

    Gaps of zero or of seven days and more do not count; a day is assumed when no gap counts.
    """
    instants = items.groupBy(feed, F.unix_micros(ts).alias("us")).agg(F.count(F.lit(1)).alias("rows"))
    days = instants.groupBy(feed, floor_to(F.col("us"), C.DAY_US).alias("day")).agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.count("us").alias("instants"), F.sum("rows").alias("rows"),
        F.sum(F.when(F.col("us").isNotNull(), F.col("rows")).otherwise(0)).alias("dated"),
    )
    before = F.lag("last_us").over(Window.partitionBy(feed).orderBy("day"))
    gap = F.col("first_us") - before
    counted = days.withColumn("gap", F.when(gap < C.LONGEST_GAP_US, gap))
    per_feed = counted.groupBy(feed).agg(
        F.sum("rows").alias("items"), F.sum("dated").alias("dated"),
        F.sum(F.coalesce(F.col("last_us") - F.col("first_us"), F.lit(0)) + F.coalesce("gap", F.lit(0))).alias("total"),
        F.sum(F.greatest(F.col("instants") - 1, F.lit(0)) + F.when(F.col("gap").isNotNull(), 1).otherwise(0)).alias("gaps"),
    )
    mean = F.when((F.col("dated") >= 2) & (F.col("gaps") > 0), F.expr("total div gaps"))
    return per_feed.select(
        feed, "items", F.coalesce(mean, F.lit(C.DEFAULT_INTERVAL_US).cast("bigint")).alias("interval_us")
    )


def ttl_of(
    interval_us: Column, items: Column, default_us: int = C.TTL_DEFAULT_US,
    high_us: int = C.TTL_HIGH_US, low_us: int = C.TTL_LOW_US,
) -> Column:
    """Refresh time from cadence and feed size; the default for a feed without items."""
    return (
        F.when(items.isNull() | (items == 0), default_us)
        .when(interval_us <= C.HOUR_US, high_us)
        .when(interval_us >= C.DAY_US, low_us)
        .when(items > C.LARGE_FEED, default_us * 2)
        .when(items < C.SMALL_FEED, default_us // 2)
        .otherwise(default_us)
        .cast("bigint")
    )


def adaptive_ttl(items: DataFrame, feeds: DataFrame | None = None, **ttls: int) -> DataFrame:
    """Per feed: items, interval and refresh time; ``feeds`` adds feeds that have no items yet."""
    cadence = update_interval(items)
    if feeds is not None:
        cadence = feeds.select("feed_url").join(cadence, "feed_url", "left").fillna(0, ["items"])
    return cadence.withColumn("ttl_us", ttl_of(F.col("interval_us"), F.col("items"), **ttls))


def freshness_asof(requests: DataFrame, fetches: DataFrame, ranges: int | None = None) -> DataFrame:
    """Requests with the latest earlier fetch of their feed and the verdict HIT or MISS.

    ``requests``: feed_url, ts, force_refresh and any other columns; ``fetches``: feed_url, fetched_at,
    expires_at.  A request is a HIT when the latest fetch strictly before it has not expired and it is
    not forced.

    A scan in two passes: all rows are dealt into ``ranges`` of equal size along (feed, time), whatever share
    one feed or instant has.  The last fetch of every range is carried on to the ranges after it in which its feed
    goes on, one row for each range at most; within its range each request then sees the last fetch before it.
    """
    spark = requests.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    payload = [c for c in requests.columns if c not in ("feed_url", "ts")]
    asked = requests.select("feed_url", "ts", F.lit(1).alias("turn"), F.struct(*payload).alias("request"))
    got = fetches.select("feed_url", F.col("fetched_at").alias("ts"), F.lit(2).alias("turn"), F.struct("fetched_at", "expires_at").alias("fetch"))
    order = ["feed_url", "ts", "turn", "fetch", "nth"]
    line = got.unionByName(asked, allowMissingColumns=True).withColumn("nth", F.monotonically_increasing_id())
    line = stored(line.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "asof")

    marks = line.groupBy("part", "feed_url").agg(F.max("fetch").alias("fetch"))
    earlier = Window.partitionBy("feed_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("part", "feed_url", F.max("fetch").over(earlier).alias("carried")).filter("carried is not null")
    so_far = Window.partitionBy("part", "feed_url").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = line.withColumn("known", F.last("fetch", ignorenulls=True).over(so_far)).filter("turn = 1")
    # a feed goes on into a range only where a range begins: no more rows than ranges
    seen = seen.join(F.broadcast(carried), ["part", "feed_url"], "left").withColumn("known", F.coalesce("known", "carried"))
    fresh = F.coalesce(F.col("known.expires_at") >= F.col("ts"), F.lit(False)) & ~F.col("request.force_refresh")
    return seen.select(
        "feed_url", "ts", "request.*", F.col("known.fetched_at").alias("fetched_at"),
        F.col("known.expires_at").alias("expires_at"), F.when(fresh, "HIT").otherwise("MISS").alias("verdict"),
    )


def refresh_plan(catalog: DataFrame, fetches: DataFrame, ttl: DataFrame, at: Column, forced: Column | None = None) -> DataFrame:
    """Feeds of the catalog with ``due`` at instant ``at``: never fetched, run out, or forced.

    ``catalog``: feed_url; ``fetches``: feed_url, fetched_at; ``ttl``: feed_url, ttl_us.
    """
    last = fetches.groupBy("feed_url").agg(F.max("fetched_at").alias("fetched_at"))
    plan = catalog.join(last, "feed_url", "left").join(ttl.select("feed_url", "ttl_us"), "feed_url", "left")
    plan = plan.withColumn("ttl_us", F.coalesce("ttl_us", F.lit(C.TTL_DEFAULT_US).cast("bigint")))
    expires = F.timestamp_micros(F.unix_micros("fetched_at") + F.col("ttl_us"))
    reason = (
        F.when(forced if forced is not None else F.lit(False), "forced")
        .when(F.col("fetched_at").isNull(), "never fetched")
        .when(expires < at, "expired")
    )
    return plan.withColumn("reason", F.coalesce(reason, F.lit("fresh"))).withColumn("due", F.col("reason") != "fresh")
