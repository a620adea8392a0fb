"""Job states of a stream: bounded store, restart, replay, sweep."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from feedlake.operators import jobs
from feedlake.plans import registry
from feedlake.session import work_dir
from feedlake.sources import files
from feedlake.streaming import jobs as J
from feedlake.streaming import tables as S

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = "job_id string, url string, step int, status string, ts timestamp, error string, items_count long, duration_ms long"


def lifecycle(job, hour, end="completed", took=9):
    at = lambda s: T0 + timedelta(hours=hour, seconds=s)
    rows = [(job, "u", 0, "pending", at(0), "", 0, 0), (job, "u", 1, "processing", at(1), "", 0, 0)]
    return rows + ([(job, "u", 2, end, at(took), "boom" if end == "failed" else "", 3, 8000)] if end else [])


def write(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder):
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    changes = J.track_jobs(events)
    query = S.start(changes, S.append_changes(f"{folder}/out", "day"), f"{folder}/checkpoint", "update")
    query.awaitTermination()
    return changes, [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]


def shaped(states):
    return sorted(map(tuple, jobs.shape_state(states).collect()), key=repr)


def direct(spark, rows):
    return jobs.merge_states(jobs.event_states(spark.createDataFrame(rows, EVENTS)))


def test_the_store_forgets_and_a_restart_goes_on(spark):
    folder = work_dir(spark, "test-jobs")
    first = [r for h in range(0, 12) for j in range(5) for r in lifecycle(f"j{h}-{j}", h, ("completed", "failed", None)[j % 3], 9 if j else 5000)]
    write(spark, f"{folder}/in", [r for r in first if r[4] < T0 + timedelta(hours=6)])
    write(spark, f"{folder}/in", [r for r in first if r[4] >= T0 + timedelta(hours=6)])
    changes, held = run(spark, folder)
    assert shaped(J.tracked_jobs(spark, f"{folder}/out", changes)) == shaped(direct(spark, first))
    assert 20 < max(held) and held[-1] < 20, held  # two hours at most are left
    # a day later one of the first jobs ends late, and one that was never submitted ends
    later = [r for j in range(4) for r in lifecycle(f"late-{j}", 40)] + [("j0-1", "u", 2, "failed", T0 + timedelta(hours=40), "late", 0, 1), ("ghost", "u", 2, "completed", T0 + timedelta(hours=40), "", 1, 1)]
    write(spark, f"{folder}/in", later)
    write(spark, f"{folder}/in", lifecycle("last", 60))
    changes, held = run(spark, folder)
    assert held[-1] <= 1, held
    everything = first + later + lifecycle("last", 60)
    assert shaped(J.tracked_jobs(spark, f"{folder}/out", changes)) == shaped(direct(spark, everything))
    now = T0 + timedelta(hours=60, seconds=9)
    want = shaped(direct(spark, everything).where(J.within(F.lit(now))))
    assert [r[0] for r in want] == ["last", "late-0", "late-1", "late-2", "late-3"]
    assert J.sweep_jobs(spark, f"{folder}/out", int(now.timestamp() * 1_000_000)) > 1
    assert J.sweep_jobs(spark, f"{folder}/out", int(now.timestamp() * 1_000_000)) == 0
    left = {d for b in files.folder_names(spark, f"{folder}/out") for d in files.folder_names(spark, f"{folder}/out/{b}") if d.startswith("day=")}
    assert left == {"day=2024-01-02", "day=2024-01-03"}
    assert shaped(J.tracked_jobs(spark, f"{folder}/out", changes).where(J.within(F.lit(now)))) == want


def test_a_replayed_batch_changes_nothing(spark):
    folder = work_dir(spark, "test-replay")
    rows = [r for j in range(6) for r in lifecycle(f"j{j}", j)]
    write(spark, f"{folder}/in", rows)
    changes, _ = run(spark, folder)
    read = lambda: shaped(J.tracked_jobs(spark, f"{folder}/out", changes))
    before = read()
    log = S.read_changes(spark, f"{folder}/out", changes.schema)
    batch = spark.createDataFrame(log.where("batch_id = 0").drop("batch_id").collect(), changes.schema)
    again = S.append_changes(f"{folder}/out", "day")
    again(batch, 0)  # the same batch, as after a crash between the write and the checkpoint
    assert read() == before
    again(batch, 7)  # the same rows under another number, as after a lost checkpoint
    assert read() == before == shaped(direct(spark, rows))


def test_added_jobs_need_no_store_and_drop_no_event(spark):
    folder = work_dir(spark, "test-added")
    each = J.add_jobs(f"{folder}/out")
    first = [r for h in range(0, 60, 3) for r in lifecycle(f"j{h}", h, ("completed", "failed", None)[h // 3 % 3], 9 if h % 2 else 5000)]
    # a day and more behind the newest event: one job ends again, one comes whole, one was never submitted
    late = lifecycle("late", 20) + [("j0", "u", 2, "failed", T0 + timedelta(hours=30), "late", 0, 1), ("ghost", "u", 2, "completed", T0 + timedelta(hours=2), "", 1, 1)]
    nobody = [(None, "u", 0, "pending", T0, "", 0, 0), ("x", "u", 0, "pending", None, "", 0, 0)]
    batches = [first[:20] + nobody, first[20:], [], late]
    for number, rows in enumerate(batches):
        for _ in range(2):  # the second is a replay
            each(spark.createDataFrame(rows, EVENTS), number)
    changes = J.day_states(spark.createDataFrame([], EVENTS))
    everything = first + late
    read = lambda: J.tracked_jobs(spark, f"{folder}/out", changes)
    assert shaped(read()) == shaped(direct(spark, everything))
    assert read().count() == direct(spark, everything).count()
    now = T0 + timedelta(hours=60)
    want = shaped(direct(spark, everything).where(J.within(F.lit(now))))
    assert J.sweep_jobs(spark, f"{folder}/out", int(now.timestamp() * 1_000_000)) > 0
    assert shaped(read().where(J.within(F.lit(now)))) == want != []


def test_the_job_queries_hold_no_state(spark, monkeypatch):
    started, start = [], S.start
    monkeypatch.setattr(S, "start", lambda *args: started.append(start(*args)) or started[-1])
    log, changes = registry._tracked(spark, "/root/testdata/sf0.001")
    assert len(started) == 1 and len(started[0].recentProgress) >= registry.STREAM_PARTS
    assert not any(p.stateOperators for p in started[0].recentProgress)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert J.tracked_jobs(spark, log, changes).count() == events.count()
