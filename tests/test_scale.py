"""Plans and state that must hold at scale."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from feedlake.functions import dates
from feedlake.operators import dedupe
from feedlake.operators import query as Q
from feedlake.plans import derive, registry
from feedlake.schemas import ITEM
from feedlake.session import work_dir
from feedlake.sources import files, sink
from feedlake.sources import items as tables
from feedlake.streaming import ingest
from feedlake.streaming import tables as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_filters_prune_partitions(spark):
    path = work_dir(spark, "test-items")
    ts = F.timestamp_seconds(1_700_000_000 + F.col("id") * 86_400)
    rows = spark.range(300).select(
        F.lit("f").alias("feed_url"), F.concat(F.lit("http://a/"), "id").alias("link"), F.lit("t").alias("title"), F.lit("d").alias("description"),
        F.lit("a").alias("author"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pub_date"), ts.alias("pub_ts"), F.lit("h").alias("content_hash"), F.col("id").alias("ingest_seq"),
    )
    for unit in ("day", "month"):
        tables.write_items(rows, f"{path}-{unit}", unit=unit)
        stored = tables.scan_items(spark, f"{path}-{unit}", parts=True)
        low, high = "2024-01-05T01:00:00Z", "2024-02-10T20:00:00Z"
        found = Q.filter_dates(stored, low, high)
        text = plan(found)
        assert "PartitionFilters: [isnotnull(pub_part" in text and "pub_part" in text.split("PartitionFilters")[1].split("]")[0]
        assert found.count() == Q.filter_dates(rows, low, high).count() > 0
        page = Q.keyset_page(stored, low, "http://a/3")
        assert "pub_part" in plan(page).split("PartitionFilters")[1].split("]")[0]
        assert [r.link for r in page.collect()] == [r.link for r in Q.keyset_page(rows, low, "http://a/3").collect()]


def test_a_hot_hash_is_split(spark):
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        rows = spark.range(20_000).repartition(8).select(
            F.concat(F.lit("http://a/"), "id").alias("link"), F.sha2(F.col("id").cast("string"), 256).alias("title"), F.lit("d").alias("description"), F.lit("a").alias("author"),
            F.when(F.col("id") % 10 != 0, "hot").otherwise(F.col("id").cast("string")).alias("content_hash"), F.col("id").alias("ingest_seq"),
        )
        found = dedupe.drop_known(rows, rows.where("ingest_seq < 100"))
        found.write.format("noop").mode("overwrite").save()
        found.collect()
        assert "skew=true" in plan(found)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_long_fraction_keeps_its_zone(spark):
    text = "Mon, 02 Jan 2006 15:04:05.1234567890123456 +0000"
    row = spark.createDataFrame([(text,)], "p string").select(F.unix_seconds(dates.rfc1123z_to_ts(F.col("p")))).first()
    assert row[0] == 1_136_214_245


def test_a_missing_version_raises(spark):
    path = work_dir(spark, "test-state")
    assert S.read_version(spark, path, -1, "a bigint").count() == 0
    spark.range(3).withColumnRenamed("id", "a").write.parquet(S.version_path(path, 4))
    assert S.newest_version(spark, path) == 4 and S.read_version(spark, path, 4, "a bigint").count() == 3
    with pytest.raises(AnalysisException):
        S.read_version(spark, path, 3, "a bigint")


def test_streams_run_several_batches(spark):
    seen = []
    stream = registry._event_stream(spark, "/root/testdata/sf0.001")
    registry._run(stream, lambda batch, number: seen.append((number, batch.count())), work_dir(spark, "test-batches"))
    assert len(seen) >= 3 and sum(n for _, n in seen) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def landed(spark, rows):
    return spark.createDataFrame([("f", "t", link, "d", "a", "p", None, "h", n) for link, n in rows], ITEM)


def versions(df):
    return sorted((r.link, r.ingest_seq) for r in df.collect())


def test_a_batch_reads_the_buckets_of_its_links(spark):
    path = work_dir(spark, "test-landing")
    tables.append_batch(landed(spark, [(f"l{i}", i) for i in range(200)]), path, 0)
    for _ in range(2):  # the second is a replay
        tables.append_batch(landed(spark, [("l1", 300), ("new", 301)]), path, 1)
    assert tables.read_landing(spark, path).count() == 202 and tables.read_landed_items(spark, path).count() == 201
    bucket = tables.read_landing(spark, path).where("link = 'new'").first().bucket
    some = tables.read_buckets(spark, path, [bucket])
    assert all(f"bucket={bucket}/" in f for f in some.inputFiles()) and 0 < some.count() < 50
    assert tables.read_buckets(spark, path, [99]).count() == 0
    assert tables.read_buckets(spark, work_dir(spark, "test-none"), [1]).count() == 0


def test_merged_and_doubled_buckets_hold_the_same_items(spark, monkeypatch):
    monkeypatch.setattr(tables, "BUCKET_ROWS", 20)
    path = work_dir(spark, "test-merge")
    rng, want = random.Random(1), {}
    for number in range(9):
        rows = [(f"l{rng.randrange(900)}", 1000 * number + i) for i in range(120)]
        tables.append_batch(landed(spark, rows), path, number)
        want |= dict(rows)
        touched = range(tables.buckets_in(spark, path))
        tables.merge_buckets(spark, path, touched, number, most=2)
        tables.merge_buckets(spark, path, touched, number, most=2)  # as after a run that ended in between
    assert versions(tables.read_landed_items(spark, path)) == sorted(want.items())
    assert tables.buckets_in(spark, path) >= 32
    assert not [n for n in files.folder_names(spark, path) if n != f"of={tables.buckets_in(spark, path)}"]
    # a half-written doubling doesn't count
    tables.read_landing(spark, path).limit(1).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket", "batch_id").parquet(f"{path}/of=4096")
    files.remove(spark, f"{path}/of=4096/_SUCCESS")
    assert versions(tables.read_landed_items(spark, path)) == sorted(want.items())


def test_reads_of_a_batch_do_not_grow_with_the_history(spark, monkeypatch):
    path, report = work_dir(spark, "test-history"), work_dir(spark, "test-report")
    each = ingest.ingest_batches(path, report, merge_after=3)
    read, inside = [], tables.read_buckets

    def counted(spark, path, buckets):
        out = inside(spark, path, buckets)
        read.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(sink, "read_buckets", counted)
    documents, per_batch = "feed_url string, body string, ingest_seq long", []
    for number in range(14):
        items = "".join(f"<item><title>t{number}-{i}</title><link>http://a/{number % 3}/{i}</link><description>d{i}</description></item>" for i in range(6))
        docs = spark.createDataFrame([("f", f"<rss><channel>{items}</channel></rss>", number)], documents)
        each(ingest.entries(docs), number)
        per_batch.append(read[0])
        read.clear()
    assert max(per_batch[7:]) <= 6 * (3 + 2) and max(per_batch[10:]) <= max(per_batch[4:10])
    assert tables.read_landed_items(spark, path).count() == 18
    assert spark.read.parquet(report).agg(F.sum("new")).first()[0] == 18


def test_entries_of_neighbouring_documents_keep_their_order(spark):
    """Ten entries of document 7 do not overtake document 8."""
    path, report = work_dir(spark, "test-order"), work_dir(spark, "test-report")
    item = lambda link, title: f"<item><title>{title}</title><link>http://a/{link}</link><description>{title}</description></item>"
    docs = [(7, "".join(item(i if i < 9 else "x", f"seven {i}") for i in range(10))), (8, item("x", "eight"))]
    frame = spark.createDataFrame([("f", f"<rss><channel>{b}</channel></rss>", n) for n, b in docs], "feed_url string, body string, ingest_seq long")
    ingest.ingest_batches(path, report)(ingest.entries(frame), 0)
    assert {r.link: r.title for r in tables.read_landed_items(spark, path).select("link", "title").collect()}["http://a/x"] == "eight"


def test_a_crawl_is_judged_as_a_whole(spark):
    """Equal texts in different micro-batches and in captures that overlap: the last with a stored link decides for all."""
    rng = random.Random(8)
    fields = ["link", "title", "author", "pub_date", "content_hash"]
    rows = lambda df: sorted(map(tuple, df.select(*fields).collect()))
    item = lambda n, t: f"<item><title>{t}</title><link>http://a/{n}</link><description>d</description></item>"
    texts = [f"t{rng.randrange(6)}" for _ in range(60)]
    # three feeds take turns, so each of their captures of ten spans thirty entries
    captures = [[n for n in range(60) if n % 3 == feed and n // 30 == half] for half in range(2) for feed in range(3)]
    documents = spark.createDataFrame(
        [("f", f"<rss><channel>{''.join(item(n, texts[n]) for n in c)}</channel></rss>", c[0], c) for c in captures],
        "feed_url string, body string, ingest_seq long, numbers array<long>")
    entries = ingest.entries(documents)
    assert {(r.link, r.ingest_seq) for r in entries.select("link", "ingest_seq").collect()} == {(f"http://a/{n}", n) for n in range(60)}
    draft = F.concat(F.lit("[draft] "), "title")
    old = entries.where("ingest_seq % 4 < 2")
    stored = old.withColumn("title", F.when(F.col("ingest_seq") % 3 == 0, draft).otherwise(F.col("title"))).withColumn(
        "content_hash", F.md5(F.concat("title", "description", "author"))).select(*ITEM.fieldNames())
    want = rows(dedupe.upsert_items(stored, entries.select(*ITEM.fieldNames())))
    new = dedupe.drop_known(entries, stored).count()
    path, offers, report = (work_dir(spark, f"test-crawl-{k}") for k in ("log", "offers", "report"))
    tables.append_batch(stored, path, 0)
    each, halves = ingest.offer_batches(offers), [documents.where(F.col("ingest_seq") < 30), documents.where(F.col("ingest_seq") >= 30)]
    for number, part in enumerate(halves):
        for _ in range(2):  # the second is a replay
            each(ingest.entries(part), number)
    for _ in range(2):
        ingest.put_offers(spark, offers, path, report, 1)
        assert rows(tables.read_landed_items(spark, path)) == want
    assert [tuple(r) for r in spark.read.parquet(report).select("entries", "invalid", "new", "duplicates").collect()] == [(60, 0, new, 60 - new)]
    # put by themselves, the batches give something else
    other = work_dir(spark, "test-crawl-other")
    tables.append_batch(stored, other, 0)
    for number, part in enumerate(halves):
        ingest.ingest_batches(other, f"{other}-report", first_batch=1)(ingest.entries(part), number)
    assert rows(tables.read_landed_items(spark, other)) != want


def test_captures_know_the_numbers_of_their_entries(spark):
    got = ingest.entries(derive.capture_documents(spark, "/root/testdata/sf0.001"))
    want = derive.raw_items(spark, "/root/testdata/sf0.001")
    assert {(r.link, r.ingest_seq) for r in got.select("link", "ingest_seq").collect()} == {(r.link, r.ingest_seq) for r in want.collect()}


def served(spark, path, rows, unit="day"):
    """Items with (link, day of January 2024 or None, hour)."""
    base = 1_704_067_200
    frame = spark.createDataFrame([(link, None if d is None else base + (d - 1) * 86_400 + h * 3600) for link, d, h in rows], "link string, s long")
    ts = F.timestamp_seconds("s")
    tables.write_items(frame.select(
        F.lit("f").alias("feed_url"), F.lit("t").alias("title"), "link", F.lit("d").alias("description"), F.lit("a").alias("author"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pub_date"), ts.alias("pub_ts"), F.lit("h").alias("content_hash"), F.lit(1).cast("long").alias("ingest_seq"),
    ), path, unit)


def names(spark, path):
    return {f: files.folder_names(spark, f"{path}/{f}") for f in files.folder_names(spark, path) if f.startswith("pub_part=")}


def test_retention_leaves_other_files_alone(spark, monkeypatch):
    path = work_dir(spark, "test-retention")
    served(spark, path, [(f"l{d}-{h}", d, h) for d in range(1, 11) for h in (1, 13)] + [("undated", None, 0)])
    before = names(spark, path)
    cut = F.timestamp_seconds(F.lit(1_704_067_200 + 4 * 86_400 + 12 * 3600))  # noon of the fifth

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # a run that fails before the commit changes nothing
        m.setattr(tables, "stored", fails)
        with pytest.raises(RuntimeError):
            tables.expire_items(spark, path, cut)
    assert names(spark, path) == before and tables.scan_items(spark, path).count() == 21
    with monkeypatch.context() as m:  # one that fails after it is completed by the next
        m.setattr(tables, "remove", fails)
        with pytest.raises(RuntimeError):
            tables.expire_items(spark, path, cut)
    assert tables.scan_items(spark, path).count() == 20
    assert tuple(tables.expire_items(spark, path, cut).first()) == (12, 8)
    after = names(spark, path)
    assert sorted(after) == ["pub_part=2024-01-%02d" % d for d in range(5, 11)] + ["pub_part=__HIVE_DEFAULT_PARTITION__"]
    assert {k: v for k, v in after.items() if "01-05" not in k} == {k: before[k] for k in after if "01-05" not in k}
    assert {r.link for r in tables.scan_items(spark, path).where("link like 'l5%'").collect()} == {"l5-13"}
    assert tuple(tables.expire_items(spark, path, cut).first()) == (12, 0) and names(spark, path) == after
    assert tuple(tables.expire_items(spark, path, F.timestamp_seconds(F.lit(2_000_000_000))).first()) == (1, 11)


def test_puts_replace_and_repeat(spark):
    path = work_dir(spark, "test-puts")
    first = landed(spark, [("a", 1), ("b", 2), ("b", 3)]).withColumn("content_hash", F.concat(F.lit("h"), "ingest_seq"))
    assert tuple(sink.put_items(first, path, 0).first()) == (3, 1)
    again = landed(spark, [("b", 5), ("c", 6), ("c", 7)]).withColumn("content_hash", F.concat(F.lit("h"), "ingest_seq"))
    for _ in range(2):
        assert tuple(sink.put_items(again, path, 1, dedupe=False).first()) == (3, 1)
    assert versions(tables.read_landed_items(spark, path)) == [("a", 1), ("b", 5), ("c", 7)]
    assert tuple(sink.put_items(again, path, 2).first()) == (0, 0)
    assert tuple(sink.put_items(landed(spark, []), path, 3).first()) == (0, 0)


def test_stream_parts_have_several_files(spark, monkeypatch):
    monkeypatch.setattr(registry, "FILE_ROWS", 20)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = registry._streamed(spark, events, "ts")
    seen = []

    def each(batch, number):
        times = batch.agg(F.min("ts"), F.max("ts")).first()
        seen.append((batch.select(F.input_file_name()).distinct().count(), *times))

    registry._run(stream, each, work_dir(spark, "test-files"))
    assert [n for n, *_ in seen] == [registry.STREAM_FILES] * registry.STREAM_PARTS
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:]))


def rows_scanned(df):
    """Rows of the row groups that a plain scan with its filters has opened."""
    executed = df._jdf.queryExecution()
    executed.toRdd().count()
    return executed.executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_lookups_open_few_row_groups(spark):
    """One author has a third of all rows; others and single links are found in a small share of the groups."""
    path = work_dir(spark, "test-lookup")
    n = 60_000
    author = F.when(F.col("id") % 3 == 0, "busy").otherwise(F.concat(F.lit("a"), F.col("id") % 500))
    rows = spark.range(n).select(
        F.lit("f").alias("feed_url"), F.sha2(F.col("id").cast("string"), 256).alias("title"), F.concat(F.lit("http://x/"), F.md5(F.col("id").cast("string"))).alias("link"), F.lit("d").alias("description"),
        author.alias("author"), F.lit("p").alias("pub_date"), F.lit(None).cast("timestamp").alias("pub_ts"), F.sha2(F.concat("id", F.lit("x")), 256).alias("content_hash"), F.col("id").alias("ingest_seq"),
    )
    tables.write_lookup(rows, path, group_bytes=200_000)
    sizes = [len(spark.read.parquet(f"{path}/{f}").select("author").distinct().limit(3).collect()) for f in files.folder_names(spark, path) if f.endswith(".parquet")]
    assert len(sizes) == 4
    stored = tables.scan_lookup(spark, path)
    one = Q.filter_author(stored, "a77")
    assert one.count() == rows.where("author = 'a77'").count() > 0 and rows_scanned(one.select("author")) < n / 10
    link = rows.where("id = 12345").first().link
    assert [r.ingest_seq for r in Q.filter_links(stored, [link]).collect()] == [12345]
    assert rows_scanned(Q.filter_links(stored, [link]).select("link")) < n / 5
    assert Q.filter_links(stored, []).count() == 0 and rows_scanned(Q.filter_links(stored, ["http://x/none"]).select("link")) < n / 5
    assert Q.filter_author(stored, "busy").count() == n // 3
