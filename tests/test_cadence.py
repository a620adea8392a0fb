"""Cadence, refresh times, freshness and age buckets."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from feedlake import constants as C
from feedlake.functions import dates
from feedlake.operators import cadence, retention

DAY = 86_400_000_000


def feed_items(spark, rows):
    df = spark.createDataFrame(rows, "feed_url string, us long")
    return df.withColumn("pub_ts", F.timestamp_micros("us"))


def brute_interval(times, count):
    times = sorted((t for t in times if t is not None), reverse=True)
    gaps = [a - b for a, b in zip(times, times[1:]) if 0 < a - b < 7 * DAY]
    if count < 2 or len(times) < 2 or not gaps:
        return DAY
    return sum(gaps) // len(gaps)


@pytest.mark.parametrize("step_min, count, interval_min, ttl_min", [
    (1, 10, 1, 5), (48 * 60, 5, 48 * 60, 60), (360, 5, 360, 7.5), (360, 150, 360, 30), (360, 50, 360, 15), (60, 3, 60, 5),
])
def test_refresh_time_by_frequency_and_size(spark, step_min, count, interval_min, ttl_min):
    rows = [("f", 1_700_000_000_000_000 - i * step_min * C.MINUTE_US) for i in range(count)]
    row = cadence.adaptive_ttl(feed_items(spark, rows)).first()
    assert (row.interval_us, row.ttl_us) == (interval_min * C.MINUTE_US, ttl_min * C.MINUTE_US)


def test_feed_without_items_gets_the_default(spark):
    none = feed_items(spark, [("f", 0)])
    feeds = spark.createDataFrame([("g",)], "feed_url string")
    row = cadence.adaptive_ttl(none, feeds).first()
    assert (row.feed_url, row["items"], row.ttl_us) == ("g", 0, C.TTL_DEFAULT_US)


def test_interval_equals_the_sorted_walk(spark):
    rng = random.Random(1)
    rows = []
    for f in range(12):
        t = rng.randrange(-10 * DAY, 400 * DAY)
        for _ in range(rng.choice([1, 2, 3, 40, 200])):
            rows.append((f"f{f}", t))
            t += rng.choice([0, 0, 1, 3_600_000_000, rng.randrange(2 * DAY), 7 * DAY, 7 * DAY - 1, 30 * DAY])
        if f % 3 == 0:
            rows += [(f"f{f}", None), (f"f{f}", -62135596800000000)]
    got = {r.feed_url: (r["items"], r.interval_us) for r in cadence.update_interval(feed_items(spark, rows)).collect()}
    for f in {r[0] for r in rows}:
        times = [t for g, t in rows if g == f]
        assert got[f] == (len(times), brute_interval(times, len(times)))


def test_freshness_equals_the_lookup_row_by_row(spark):
    rng = random.Random(2)
    base = 1_700_000_000_000_000
    fetches, asked = [], []
    for i in range(400):
        feed = "hot" if i % 3 else f"f{rng.randrange(5)}"
        at = base + rng.randrange(3 * DAY) // 1_000_000 * 1_000_000
        fetches.append((feed, at, at + rng.choice([5, 60, 600]) * C.MINUTE_US))
    for i in range(600):
        feed = "hot" if i % 3 else f"f{rng.randrange(7)}"
        at = fetches[rng.randrange(400)][1] if i % 5 == 0 else base - DAY // 4 + rng.randrange(4 * DAY)
        asked.append((feed, at, i, i % 10 == 0))
    fetch_df = spark.createDataFrame(fetches, "feed_url string, f long, e long").select(
        "feed_url", F.timestamp_micros("f").alias("fetched_at"), F.timestamp_micros("e").alias("expires_at"))
    ask_df = spark.createDataFrame(asked, "feed_url string, t long, id int, force_refresh boolean").select(
        "feed_url", F.timestamp_micros("t").alias("ts"), "id", "force_refresh")
    expected = {}
    for feed, at, i, force in asked:
        before = [(f, e) for g, f, e in fetches if g == feed and f < at]
        last = max(before, default=None)
        hit = last is not None and last[1] >= at and not force
        expected[i] = (last[0] if last else None, "HIT" if hit else "MISS")
    for ranges in (1, 3, 40, None):
        rows = cadence.freshness_asof(ask_df, fetch_df, ranges).select("id", F.unix_micros("fetched_at").alias("f"), "verdict").collect()
        assert {r.id: (r.f, r.verdict) for r in rows} == expected and len(rows) == len(asked)


def test_one_feed_and_instant_is_spread_over_all_ranges(spark, monkeypatch):
    base = 1_700_000_000
    kind = F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("f"), (F.col("id") % 7).cast("string")))
    ts = F.timestamp_seconds(F.when(F.col("id") % 3 == 0, base).otherwise(base + F.col("id") % 3600))  # a third at one instant
    asked = spark.range(40_000).select(kind.alias("feed_url"), ts.alias("ts"), "id", F.lit(False).alias("force_refresh"))
    fetches = spark.range(5).select(F.lit("hot").alias("feed_url"), F.timestamp_seconds(base + F.col("id") * 500).alias("fetched_at"), F.timestamp_seconds(base + F.col("id") * 500 + 60).alias("expires_at"))
    kept = []
    inside = cadence.stored
    monkeypatch.setattr(cadence, "stored", lambda df, label: kept.append(inside(df, label)) or kept[-1])
    seen = cadence.freshness_asof(asked, fetches, 16)
    sizes = [r["count"] for r in kept[0].groupBy("part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 40_000 / 16
    late = seen.where("feed_url = 'hot' and id % 3 <> 0").select(((F.unix_seconds("ts") - base) > 0).alias("after"), (F.unix_seconds("fetched_at") - base).alias("f"), (F.unix_seconds("ts") - base).alias("t"))
    assert late.where("after and f <> least(int((t - 1) / 500), 4) * 500").count() == 0 and late.where("after and f is null").count() == 0
    assert seen.where("id % 3 = 0 and fetched_at is not null").count() == 0  # not strictly before


def test_refresh_reasons(spark):
    at = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
    catalog = spark.createDataFrame([("new",), ("old",), ("young",), ("told",)], "feed_url string")
    fetches = spark.createDataFrame(
        [("old", at - timedelta(minutes=16)), ("young", at - timedelta(minutes=15)), ("told", at)], "feed_url string, fetched_at timestamp")
    ttl = spark.createDataFrame([("old", 900_000_000)], "feed_url string, ttl_us long")
    plan = cadence.refresh_plan(catalog, fetches, ttl, dates.instant("2024-01-01T12:00:00Z"), F.col("feed_url") == "told")
    assert {r.feed_url: (r.reason, r.due) for r in plan.collect()} == {
        "new": ("never fetched", True), "old": ("expired", True), "young": ("fresh", False), "told": ("forced", True)}


def test_buckets_and_future_add_up_to_the_total(spark):
    now = dates.instant_us("2024-07-01T00:00:00Z")
    offsets = [1, 0, -1, -DAY, -DAY - 1, -7 * DAY, -7 * DAY - 1, -30 * DAY, -30 * DAY - 1, None]
    items = feed_items(spark, [("f", None if o is None else now + o) for o in offsets])
    got = {r.bucket: r["items"] for r in retention.age_buckets(items, "2024-07-01T00:00:00Z").collect()}
    assert got == {"total": 10, "last_24h": 2, "last_7d": 2, "last_30d": 2, "older_30d": 1}
    cut = retention.cutoff("2024-07-01T00:00:00Z")
    assert items.filter(retention.survives(cut)).count() == 9 and items.filter(~retention.survives(cut)).count() == 1
    with pytest.raises(ValueError):
        retention.cutoff("2024-07-01T00:00:00Z", 366)
