"""Roll-ups, job state and alerts."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from feedlake import constants as C
from feedlake.operators import alerts, jobs, metrics
from feedlake.session import work_dir
from feedlake.streaming import alerts as running
from feedlake.streaming import rollups

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_histogram_is_cumulative_and_ends_with_the_count(spark):
    values = [-1.0, 0.0, 0.005, 0.006, 3.0, 11.0]
    df = spark.createDataFrame([("a", v) for v in values], "label string, v double")
    rows = {r.le: r for r in metrics.histogram_rollup(df, "m", "v", ["label"]).collect()}
    assert [rows[str(b)].bucket for b in C.DURATION_BOUNDS] == [2, 3, 3, 3, 3, 3, 3, 3, 3, 4, 4]
    assert rows["+Inf"].bucket == rows["+Inf"]["count"] == 5 and rows["+Inf"].sum == 14.011


def test_counter_labels(spark):
    df = spark.createDataFrame([("GET", 200), ("GET", 200), ("POST", 500)], "method string, status int")
    got = {(r.metric, r.labels): r.value for r in metrics.counter_rollup(df, "m", ["method", "status"]).collect()}
    assert got == {("m", "method=GET,status=200"): 2, ("m", "method=POST,status=500"): 1}


def test_running_level_equals_the_walk(spark):
    rng = random.Random(9)
    rows = [(T0 + timedelta(seconds=rng.randrange(5 * 86400)), rng.choice([1, -1])) for _ in range(500)]
    got = metrics.running_level(spark.createDataFrame(rows, "ts timestamp, delta int"))
    got = {r.us: r.value for r in got.select(F.unix_micros("ts").alias("us"), "value").collect()}
    level, expected = 0, {}
    for ts, d in sorted(rows):
        level += d
        minute = (ts - T0) // timedelta(minutes=1) + 1
        expected[int((T0 + minute * timedelta(minutes=1)).timestamp()) * 1_000_000] = level
    assert got == expected


def test_gauge_keeps_the_newest(spark):
    df = spark.createDataFrame([(T0, "g", 5), (T0 + timedelta(1), "g", 2), (T0, "h", 1)], "ts timestamp, name string, value int")
    assert {r.name: r.value for r in metrics.gauge_last(df).collect()} == {"g": 2, "h": 1}


def test_success_rate_windows(spark):
    df = spark.createDataFrame([(T0, "success"), (T0 + timedelta(minutes=2), "failed")], "ts timestamp, status string")
    got = {r.m: r.success_pct for r in metrics.success_rate(df).select(
        ((F.unix_seconds("window_start") - int(T0.timestamp())) / 60).cast("int").alias("m"), "success_pct").collect()}
    assert got == {-4: 100.0, -3: 100.0, -2: 50.0, -1: 50.0, 0: 50.0, 1: 0.0, 2: 0.0}
    with pytest.raises(ValueError):
        metrics.success_rate(df, 5, 2)


def test_log_levels_and_bodies(spark):
    rows = [(200, "x", "x"), (404, "", "e"), (500, "x" * 1023, "e" * 1024), (399, "x" * 1024, "e")]
    df = spark.createDataFrame(rows, "status int, request_body string, response_body string")
    got = [(r.level, r.request_body and len(r.request_body), r.response_body) for r in metrics.classify_http_log(df).collect()]
    assert got == [("info", 1, None), ("warn", None, "e"), ("error", 1023, None), ("info", None, None)]


EVENTS = "job_id string, url string, step int, status string, ts timestamp, error string, items_count long, duration_ms long"


def test_job_states(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [
        ("a", "u", 0, "pending", at(0), "", 0, 0), ("a", "u", 1, "processing", at(1), "", 0, 0), ("a", "u", 2, "failed", at(5), "boom", 0, 4000),
        ("b", "u", 0, "pending", at(0), "", 0, 0), ("b", "u", 1, "processing", at(2), "", 0, 0),
        ("c", "u", 0, "pending", at(0), "", 0, 0),
        ("ghost", "u", 2, "completed", at(9), "", 3, 1),
    ]
    state = jobs.job_state(spark.createDataFrame(rows, EVENTS))
    seconds = lambda c: F.unix_seconds(c) - int(T0.timestamp())
    got = {r.job_id: (r.status, r.done, r.began, r.error, r.duration_ms) for r in state.select(
        "job_id", "status", seconds("completed_at").alias("done"), seconds("started_at_derived").alias("began"), "error", "duration_ms").collect()}
    assert got == {
        "a": ("failed", 5, 1, "boom", 4000), "b": ("processing", 2, 2, "", 0), "c": ("pending", None, None, "", 0)}
    assert jobs.lookup_job(state, "nope").count() == 0 and jobs.lookup_job(state, "a").count() == 1
    later = F.lit(T0 + timedelta(hours=24))
    assert jobs.drop_old_jobs(state, later).count() == 3
    assert jobs.drop_old_jobs(state, F.lit(T0 + timedelta(hours=24, seconds=1))).count() == 0


def windows(spark, rates, skip=()):
    rows = [(T0 + timedelta(hours=i), float(r), 0.0, 0) for i, r in enumerate(rates) if i not in skip]
    return spark.createDataFrame(rows, "window_start timestamp, failure_rate double, queue_load double, store_errors long")


def hours(df):
    h = lambda c: ((F.unix_seconds(c) - int(T0.timestamp())) / 3600).cast("int")
    return sorted((r.a, r.b) if r.b is not None else (r.a, None) for r in df.select(h("started_at").alias("a"), h("resolved_at").alias("b")).collect())


def test_an_alert_opens_once_and_resolves_at_the_first_quiet_window(spark):
    eps = alerts.alert_episodes(windows(spark, [0, .9, .9, 0, .9, 0, 0, .9]), alerts.default_rules())
    assert hours(eps) == [(2, 4), (5, 6), (8, None)]
    row = eps.orderBy("started_at").first()
    assert row.alert_id == f"high_error_rate-{int(T0.timestamp()) + 7200}" and row.log_level == "warn" and row.labels == {"service": "feedlake"}
    assert hours(alerts.active_alerts(eps, F.lit(T0 + timedelta(hours=5)))) == [(5, 6)]
    assert hours(alerts.active_alerts(eps, F.lit(T0 + timedelta(hours=6)))) == []


def test_a_missing_window_ends_an_episode(spark):
    eps = alerts.alert_episodes(windows(spark, [.9, .9, .9], skip=(1,)), alerts.default_rules())
    assert hours(eps) == [(1, 2), (3, None)]


def test_one_alert_per_type_and_disabled_rules(spark):
    low = alerts.AlertRule("low", "high_error_rate", "critical", "t", "d", "failure_rate > 0.5")
    off = alerts.AlertRule("off", "queue_full", "low", "t", "d", "true", enabled=False)
    eps = alerts.alert_episodes(windows(spark, [.3, .9, 0]), [low, *alerts.default_rules(), off]).collect()
    assert [(e.type, e.severity) for e in eps] == [("high_error_rate", "high")]
    with pytest.raises(ValueError):
        alerts.AlertRule("x", "unknown", "low", "t", "d", "true")


def test_window_lengths():
    assert alerts.window_us("1 hour") == C.HOUR_US and alerts.window_us("5 minutes") == 5 * C.MINUTE_US
    with pytest.raises(ValueError):
        alerts.window_us("soon")


def test_running_alerts_tell_each_event_once(spark):
    """Batches of windows give the episodes of all windows at once; replays and a restarted notifier tell nothing twice."""
    rng = random.Random(6)
    for case in range(3):
        rates = [rng.choice([0, .9]) for _ in range(14)]
        skip = set(rng.sample(range(14), 2))
        folder = work_dir(spark, "test-alerts")
        each = running.watch(f"{folder}/outbox", f"{folder}/state", alerts.default_rules())
        told = []
        tell = lambda: running.notify(spark, f"{folder}/outbox", f"{folder}/notifier", lambda rows: told.extend((r.kind, r.alert_id) for r in rows)).awaitTermination()
        at = 0
        for number, size in enumerate((1, 4, 0, 3, 6)):
            part = windows(spark, rates, skip).where((F.unix_seconds("window_start") >= int(T0.timestamp()) + at * 3600) & (F.unix_seconds("window_start") < int(T0.timestamp()) + (at + size) * 3600))
            each(part, number)
            if case == 0:
                tell()
                each(part, number)  # replayed after it was told
                tell()
            at += size
        tell()
        want = alerts.alert_episodes(windows(spark, rates, skip), alerts.default_rules())
        assert hours(running.episodes_told(spark, f"{folder}/outbox")) == hours(want)
        closed = {r.alert_id: r.windows for r in want.collect() if r.resolved_at}
        assert {r.alert_id: r.windows for r in running.episodes_told(spark, f"{folder}/outbox").where("resolved_at is not null").collect()} == closed
        if case == 0:
            # a replayed folder has new file names, so a notifier of files may see it again; the events are the same
            told = sorted(set(told))
        events = sorted((r.kind, r.alert_id) for r in running.told_alerts(spark, f"{folder}/outbox").collect())
        assert sorted(told) == events and len(set(events)) == len(events)


def test_an_open_alert_counts_the_windows_since_it_was_told(spark):
    folder = work_dir(spark, "test-alerts-open")
    each = running.watch(f"{folder}/outbox", f"{folder}/state", alerts.default_rules())
    rates = [0, .9, 0, .9, .9, .9, .9, .9]
    for number, (low, high) in enumerate(((0, 4), (4, 6), (6, 6), (6, 8))):
        hour = (F.unix_seconds("window_start") - int(T0.timestamp())) / 3600
        each(windows(spark, rates).where((hour >= low) & (hour < high)), number)
        got = running.episodes_told(spark, f"{folder}/outbox", f"{folder}/state")
        want = alerts.alert_episodes(windows(spark, rates[:high]), alerts.default_rules())
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_late_rows_are_counted_and_reported(spark):
    folder = work_dir(spark, "test-late")
    each = rollups.add_counters(f"{folder}/out")
    row = lambda minutes, n=1: [(T0 + timedelta(minutes=minutes), "m", "a=1", 1.0)] * n
    batches = [row(300), row(301) + row(180, 3) + row(290), [], row(10, 2) + row(305)]  # two hours late and more
    for number, rows in enumerate(batches):
        for _ in range(2):  # the second is a replay
            each(spark.createDataFrame(rows, "ts timestamp, metric string, labels string, value double"), number)
    got = rollups.added_counters(spark, f"{folder}/out").select(((F.unix_seconds("window_start") - int(T0.timestamp())) / 3600).cast("int").alias("h"), "value", "late").collect()
    assert {r.h: (r.value, r.late) for r in got} == {0: (2, 2), 3: (3, 3), 4: (1, 0), 5: (3, 0)}


def test_late_rows_of_histograms_and_rates(spark):
    folder = work_dir(spark, "test-late-histograms")
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    batches = [[(at(3000), 0.2)], [(at(10), 0.7), (at(10), 40.0)], [], [(at(20), 0.2)]]
    each, rates = rollups.add_histograms(f"{folder}/h"), rollups.add_fetches(f"{folder}/r")
    for number, rows in enumerate(batches):
        for _ in range(2):  # the second is a replay
            each(spark.createDataFrame([(t, C.JOB_SECONDS, "a=1", v) for t, v in rows], "ts timestamp, metric string, labels string, value double"), number)
            rates(spark.createDataFrame([(t, "success" if v < 1 else "failed") for t, v in rows], "ts timestamp, status string"), number)
    day = F.unix_seconds("window_start") < int(at(2000).timestamp())
    got = rollups.added_histograms(spark, f"{folder}/h").where(day).collect()
    assert {(r["sum"], r["count"], r.late) for r in got} == {(40.9, 3, 3)}
    assert len(got) == len(C.DURATION_BOUNDS) + 1
    assert {r.le: r.bucket for r in got} == {**{str(b): sum(v <= b for v in (.7, 40, .2)) for b in C.DURATION_BOUNDS}, "+Inf": 3}
    rate = rollups.added_success_rate(spark, f"{folder}/r").where(day)
    assert sorted((r.fetches, r.success_pct, r.late) for r in rate.collect()) == [(1, 100.0, 1)] * 5 + [(2, 50.0, 2)] * 5
