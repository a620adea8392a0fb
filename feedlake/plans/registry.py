"""One query per operator, over tables derived from the shared test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake import constants as C
from feedlake.functions import dates
from feedlake.operators import alerts as A
from feedlake.operators import admission, cadence, clients, dedupe, jobs, metrics, retention, screening
from feedlake.operators import items as I
from feedlake.operators import query as Q
from feedlake.plans import derive as D
from feedlake.schemas import ITEM as ITEM_SCHEMA
from feedlake.session import work_dir
from feedlake.sources import catalog, feeds, httplog, keywords, sink
from feedlake.sources import items as tables
from feedlake.streaming import alerts as stream_alerts
from feedlake.streaming import ingest, rollups, sessions
from feedlake.streaming import jobs as stream_jobs
from feedlake.streaming import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ITEM = ("title", "link", "description", "author", "pub_date")


def query(fn: Query) -> Query:
    """Register ``fn`` under its own name; clocks are read in UTC."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


# --- row transforms ----------------------------------------------------------------------------


@query
def normalize_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.normalize_items(D.raw_items(spark, sf_dir))
    return out.select("ingest_seq", "feed_url", *ITEM, F.unix_micros("pub_ts").alias("pub_us"))


@query
def validate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = I.validate_items(I.normalize_items(D.raw_items(spark, sf_dir)))
    return checked.select("ingest_seq", "link", "error")


@query
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.items(spark, sf_dir).select("ingest_seq", "link", "content_hash")


# --- sources and sinks --------------------------------------------------------------------------


# Feeds in one JSON array of a catalog, about.
CATALOG_ROWS = 5_000


@query
def feed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feeds of all documents, written as a catalog of JSON arrays and read back."""
    docs = D.table(spark, sf_dir, "documents")
    name = F.concat_ws(" ", "source", F.upper("lang"))
    known = docs.select("source", "lang").distinct().select(
        name.alias("name"), D.feed_url(F.col("source"), F.col("lang")).alias("url")
    )
    path = work_dir(spark, "catalog")
    parts = 4 + known.count() // CATALOG_ROWS
    arrays = known.groupBy(F.pmod(F.xxhash64("url"), F.lit(parts)).alias("part")).agg(F.to_json(F.collect_list(F.struct("name", "url"))).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return catalog.read_feed_catalog(spark, path)


@query
def parse_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries, read back out of the RSS documents they were put in."""
    parsed = feeds.parse_feed_documents(D.feed_documents(spark, sf_dir))
    return I.normalize_items(parsed).select("feed_url", *ITEM)


@query
def parse_mixed_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries out of captures of all four formats, each document read by its own."""
    parsed = feeds.parse_feed_documents(D.mixed_documents(spark, sf_dir))
    return I.normalize_items(parsed).select("feed_url", *ITEM)


@query
def parse_feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries out of a few large RSS files, each split over tasks."""
    path = work_dir(spark, "feed-files")
    D.write_feed_files(spark, sf_dir, path)
    parsed = feeds.parse_pieces(feeds.feed_file_pieces(spark, path))
    return I.normalize_items(parsed).select("feed_url", *ITEM)


@query
def stream_feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream."""
    folder = work_dir(spark, "feed-file-stream")
    D.write_feed_files(spark, sf_dir, f"{folder}/in")
    parsed = feeds.parse_pieces(feeds.feed_file_pieces(spark, f"{folder}/in", stream=True))
    _run(I.normalize_items(parsed).select("feed_url", *ITEM), S.append_changes(f"{folder}/out"), folder)
    return spark.read.parquet(f"{folder}/out").select("feed_url", *ITEM)


@query
def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures that can't be read: every fourth cut short, every fourth no feed at all."""
    return feeds.parse_failures(D.damaged_documents(spark, sf_dir)).select("feed_url", F.unix_seconds("fetched_at").alias("fetched_s"), "reason")


@query
def scan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written in the serving layout and scanned back."""
    path = work_dir(spark, "items")
    tables.write_items(D.items(spark, sf_dir), path, unit="month")
    return tables.scan_items(spark, path).withColumn("pub_us", F.unix_micros("pub_ts")).drop("pub_ts")


@query
def count_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys-only count over the serving layout."""
    path = work_dir(spark, "items")
    tables.write_items(D.items(spark, sf_dir), path, unit="month")
    return tables.scan_items(spark, path, keys_only=True).agg(F.count(F.lit(1)).alias("items"))


def _put(spark: SparkSession, sf_dir: str, dedupe: bool) -> tuple[str, DataFrame]:
    """The store as batch 0 of a landing log, a full re-crawl put on top; its counts."""
    path = work_dir(spark, "store")
    sink.put_items(D.store_items(spark, sf_dir), path, 0)
    return path, sink.put_items(D.recrawl(spark, sf_dir), path, 1, dedupe)


@query
def upsert_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after a full re-crawl with several versions of a link in the batch."""
    path, _ = _put(spark, sf_dir, True)
    return tables.read_landed_items(spark, path).select("link", "title", "author", "pub_date", "content_hash")


@query
def upsert_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after a put without duplicate check: every link takes its last incoming version."""
    path, _ = _put(spark, sf_dir, False)
    return tables.read_landed_items(spark, path).select("link", "title", "author", "pub_date", "content_hash")


@query
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, counts = _put(spark, sf_dir, True)
    offered = D.recrawl(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.select(offered.alias("offered"), "put", "replaced_in_batch")


@query
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.batch_plan(D.items(spark, sf_dir))


@query
def cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty-day retention on the serving layout, in place."""
    path = work_dir(spark, "items")
    tables.write_items(D.items(spark, sf_dir), path, unit="month")
    return tables.expire_items(spark, path, retention.cutoff(D.ITEMS_NOW), unit="month")


@query
def read_http_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log, written as JSON lines and read back."""
    path = work_dir(spark, "httplog")
    D.http_log(spark, sf_dir).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    log = httplog.read_http_log(spark, path)
    return _ntz(log, "time")


# --- screening, identity, logs ------------------------------------------------------------------


@query
def screen_urls_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen_urls(D.url_samples(spark, sf_dir))


@query
def screen_urls_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen_urls(D.url_samples(spark, sf_dir), level="strict")


@query
def screening_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screening_report(screening.screen_urls(D.url_samples(spark, sf_dir), level="strict"))


@query
def client_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clients.with_client_id(D.request_log(spark, sf_dir)).select("request_id", "client_id")


@query
def classify_http_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classify_http_log(D.http_log(spark, sf_dir)).select(
        "request_id", "status", "level", "message", "request_body", "response_body"
    )


ORIGINS = screening.OriginPolicy(development=(*C.DEVELOPMENT_ORIGINS, "*.wild.example"), allow_subdomains=True, domains=("partner.example",))


@query
def origin_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = screening.origin_audit(D.request_log(spark, sf_dir), ORIGINS)
    return audit.select("request_id", "origin", "environment", "allowed")


@query
def origin_audit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same audit against a table of rules: the policy's, and every customer's own site and subdomains."""
    customer = D.table(spark, sf_dir, "customer")
    site = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".example"))
    own = customer.select(F.explode(F.array(
        F.struct(F.lit("production").alias("environment"), F.concat(F.lit("https://"), site).alias("text"), F.lit(False).alias("suffix")),
        F.struct(F.lit("production").alias("environment"), F.concat(F.lit("."), site).alias("text"), F.lit(True).alias("suffix")),
    )).alias("r")).select("r.*")
    asked = D.request_log(spark, sf_dir)
    # every seventh request comes from a customer's site or a subdomain of it, over http or https
    n = F.col("request_id")
    place = F.concat(F.when(n % 2 == 0, "https://").otherwise("http://"), F.when(n % 3 == 0, "api.").otherwise(""), F.lit("c"), (n % 400).cast("string"), F.lit(".example"))
    asked = asked.withColumn("origin", F.when(n % 7 == 0, place).otherwise(F.col("origin")))
    audit = screening.origin_audit_by_rules(asked, screening.origin_rules(spark, ORIGINS).unionByName(own))
    return audit.select("request_id", "origin", "environment", "allowed")


# --- filters and pages: on the serving table ------------------------------------------------------


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items, written in the serving layout and scanned with their partitions."""
    path = work_dir(spark, "served")
    tables.write_items(D.items(spark, sf_dir), path, unit="month")
    return tables.scan_items(spark, path, parts=True)


@query
def filter_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.filter_source(_served(spark, sf_dir), "https://src1").select("link", "author", "pub_date")


def _by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "by-author")
    tables.write_lookup(D.items(spark, sf_dir), path)
    return tables.scan_lookup(spark, path)


@query
def filter_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.filter_author(_by_author(spark, sf_dir), "Unknown").select("link", "author", "pub_date")


@query
def lookup_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = [f"https://src{k}.example.org/{lang}/{k}" for k in (3, 4, 5) for lang in ("en", "de")] + ["https://src1.example.org/en/21"]
    return Q.filter_links(_by_author(spark, sf_dir), links).select("link", "author", "pub_date")


@query
def filter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q.filter_dates(_served(spark, sf_dir), "2024-06-01T00:00:00+02:00", "2024-06-30T23:00:00Z")
    return found.select("link", "author", "pub_date")


@query
def filter_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.filter_keyword(_served(spark, sf_dir), "The").select("link", "author", "pub_date")


@query
def indexed_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword of two words, through the index of words and files."""
    path = work_dir(spark, "served")
    tables.write_items(D.items(spark, sf_dir), path, unit="month")
    keywords.index_keywords(spark, path, f"{path}-words")
    return keywords.scan_keyword(spark, path, f"{path}-words", "ER. The").select("link", "author", "pub_date")


@query
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.page_items(_served(spark, sf_dir), Q.PageRequest(limit=-1, offset=30)).select(*ITEM)


@query
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page behind half of all items, found by counts of ranges."""
    served = _served(spark, sf_dir)
    half = served.count() // 2
    return Q.seek_page(served, Q.PageRequest(limit=50, offset=half), slice_rows=100).select(*ITEM)


@query
def latest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.latest_items(_served(spark, sf_dir)).select(*ITEM)


@query
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = Q.keyset_page(_served(spark, sf_dir), "2024-06-30T12:00:00Z", "https://src2")
    return page.select("link", "pub_date")


@query
def items_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = Q.ItemFilter(
        source="https://src", date_from="2024-05-01T00:00:00Z", date_to="2024-06-30T23:59:59Z", keyword="THE"
    )
    page = Q.items_page(_served(spark, sf_dir), wanted, Q.PageRequest(limit=50, cursor="offset:20"))
    return page.withColumn("items", F.to_json("items"))


@query
def items_page_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = Q.ItemFilter(source="https://src", keyword="the")
    page = Q.items_page(_served(spark, sf_dir), wanted, Q.PageRequest(limit=40, offset=10), keyword_mode="pre_page")
    return page.withColumn("items", F.to_json("items"))


# --- duplicates ---------------------------------------------------------------------------------


@query
def existing_by_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedupe.existing_by_link(D.items(spark, sf_dir), D.store_items(spark, sf_dir))
    return found.select(
        "link", "content_hash", F.col("stored.title").alias("stored_title"),
        F.col("stored.content_hash").alias("stored_hash"),
    )


@query
def drop_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = dedupe.drop_known(D.items(spark, sf_dir), D.store_items(spark, sf_dir))
    return fresh.select("ingest_seq", "link", "content_hash")


@query
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.duplicate_pairs(I.normalize_items(D.raw_items(spark, sf_dir)))


@query
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.duplicate_groups(I.normalize_items(D.raw_items(spark, sf_dir)))


# --- statistics and cadence -----------------------------------------------------------------------


@query
def age_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.age_buckets(D.items(spark, sf_dir), D.ITEMS_NOW)


@query
def update_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.update_interval(D.items(spark, sf_dir))


def _all_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.table(spark, sf_dir, "documents")
    return docs.select(D.feed_url(F.col("source"), F.col("lang")).alias("feed_url")).distinct()


@query
def adaptive_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.adaptive_ttl(D.items(spark, sf_dir), _all_feeds(spark, sf_dir))


def _fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successful fetches with the time they run out, by the cadence of their feed."""
    ttl = cadence.adaptive_ttl(D.items(spark, sf_dir)).select("feed_url", "ttl_us")
    good = D.fetch_log(spark, sf_dir).filter("status = 'success'").join(ttl, "feed_url", "left")
    keep = F.coalesce("ttl_us", F.lit(C.TTL_DEFAULT_US))
    return good.select(
        "feed_url", F.col("ts").alias("fetched_at"), F.timestamp_micros(F.unix_micros("ts") + keep).alias("expires_at")
    )


@query
def freshness_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = D.fetch_log(spark, sf_dir).select("feed_url", "ts", "event_id", "force_refresh")
    seen = cadence.freshness_asof(asked, _fetches(spark, sf_dir))
    return seen.select("event_id", "feed_url", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"), "verdict")


@query
def refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ttl = cadence.adaptive_ttl(D.items(spark, sf_dir)).select("feed_url", "ttl_us")
    at = F.timestamp_micros(F.lit(dates.instant_us("2024-01-30T12:00:00Z")))
    fetches = D.fetch_log(spark, sf_dir).filter("status = 'success'").filter(F.col("ts") < at)
    plan = cadence.refresh_plan(
        _all_feeds(spark, sf_dir), fetches.select("feed_url", F.col("ts").alias("fetched_at")), ttl, at,
        forced=F.col("feed_url").startswith("https://src3."),
    )
    return plan.withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


# --- metrics ----------------------------------------------------------------------------------------


def _logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return (
        D.fetch_log(spark, sf_dir).withColumnRenamed("feed_url", "url"),
        D.job_log(spark, sf_dir),
        D.store_log(spark, sf_dir),
        D.http_log(spark, sf_dir).withColumnRenamed("path", "endpoint"),
    )


@query
def counter_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.service_counters(*_logs(spark, sf_dir))


@query
def hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hit_ratio(D.fetch_log(spark, sf_dir))


@query
def histogram_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.service_histograms(*_logs(spark, sf_dir))


@query
def gauge_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue depth and running jobs, sampled each minute in which they changed; the last reading."""
    log = D.job_log(spark, sf_dir)
    status = F.col("status")
    queued = log.select("ts", F.when(status == "pending", 1).when(status == "processing", -1).otherwise(0).alias("delta"))
    running = log.select("ts", F.when(status == "processing", 1).when(status == "pending", 0).otherwise(-1).alias("delta"))
    samples = metrics.running_level(queued).withColumn("name", F.lit(C.QUEUE_SIZE)).unionByName(
        metrics.running_level(running).withColumn("name", F.lit(C.ACTIVE_WORKERS))
    )
    last = metrics.gauge_last(samples)
    return last.select("name", "value", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue depth at the end of every minute in which jobs were queued or taken."""
    status = F.col("status")
    log = D.job_log(spark, sf_dir).filter(status.isin("pending", "processing"))
    levels = metrics.running_level(log.select("ts", F.when(status == "pending", 1).otherwise(-1).alias("delta")))
    return levels.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


@query
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = metrics.success_rate(D.fetch_log(spark, sf_dir))
    return rate.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# --- state ------------------------------------------------------------------------------------------

JOB_TIMES = ("created_at", "started_at_derived", "completed_at")


def _ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query
def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(jobs.job_state(D.job_log(spark, sf_dir)), *JOB_TIMES)


@query
def job_state_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = jobs.job_state(D.job_log(spark, sf_dir))
    return _ntz(jobs.drop_old_jobs(state, dates.instant(D.LOGS_NOW)), *JOB_TIMES)


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = A.metric_windows(D.fetch_log(spark, sf_dir), D.queue_samples(spark, sf_dir), D.store_log(spark, sf_dir))
    return A.alert_episodes(windows, A.default_rules(store_errors=0))


def _flat_alerts(episodes: DataFrame) -> DataFrame:
    labels = F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return _ntz(episodes.withColumn("labels", labels), "started_at", "resolved_at")


@query
def alert_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_alerts(_episodes(spark, sf_dir))


@query
def active_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_alerts(A.active_alerts(_episodes(spark, sf_dir), dates.instant("2024-01-18T00:00:00Z")))


@query
def client_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clients.client_sessions(clients.with_client_id(D.request_log(spark, sf_dir)))
    return _ntz(found, "session_start", "last_seen", "session_end")


@query
def queue_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(admission.admission_summary(D.queue_samples(spark, sf_dir)), "window_start")


# --- streams: each runs off what is there, and has a batch form above --------------------------------


STREAM_PARTS = 4
# Files of a part where it has as many rows as this for each; one file below.
STREAM_FILES = 8
FILE_ROWS = 1_000


def _streamed(spark: SparkSession, rows: DataFrame, order: str, newest_first: bool = False) -> DataFrame:
    """A table as a stream of several parts by ``order``, one to a micro-batch, each of as many files."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    folder = work_dir(spark, "stream")
    files = 1
    if low is None:
        rows.write.parquet(folder)
    else:
        step = (high - low) / STREAM_PARTS
        bounds = [low + k * step for k in range(1, STREAM_PARTS)]
        part = F.lit(STREAM_PARTS - 1)
        for k in range(STREAM_PARTS - 2, -1, -1):
            part = F.when(F.col(order) < bounds[k], k).otherwise(part)
        sizes = {r.part: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
        files = STREAM_FILES if min(sizes.values()) >= STREAM_FILES * FILE_ROWS else 1
        # one after the other: the source takes files by age
        for k in sorted(sizes, reverse=newest_first):
            own = rows.where(part == k)
            (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read_events(_streamed(spark, D.table(spark, sf_dir, "events"), "ts"))


def _run(stream: DataFrame, each, folder: str, mode: str = "append") -> None:
    S.start(stream, each, f"{folder}/checkpoint", mode).awaitTermination()


def _log_streams(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Streaming forms of the four logs."""
    ev = ev or _event_stream(spark, sf_dir)
    return (
        D.fetch_log_from(ev).withColumnRenamed("feed_url", "url"), D.job_log_from(ev), D.store_log_from(ev),
        D.http_log_from(ev).withColumnsRenamed({"path": "endpoint", "time": "ts"}),
    )


def _latest(spark: SparkSession, stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Run an update-mode stream into a change log and read the last row of every key."""
    folder = work_dir(spark, label)
    _run(stream, S.append_changes(f"{folder}/out"), folder, "update")
    return S.read_latest(spark, f"{folder}/out", stream.schema, keys)


@query
def stream_counter_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six counters per hour."""
    counted = rollups.stream_counters(*_log_streams(spark, sf_dir))
    return _ntz(_latest(spark, counted, "counters", ["metric", "labels", "window_start"]), "window_start")


@query
def stream_counter_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six counters per hour from parts that arrive in the wrong order, days late; no row is dropped."""
    folder = work_dir(spark, "late")
    ev = D.read_events(_streamed(spark, D.table(spark, sf_dir, "events"), "ts", newest_first=True))
    observed = rollups.counter_observations(*_log_streams(spark, sf_dir, ev))
    _run(observed, rollups.add_counters(f"{folder}/out"), folder)
    return _ntz(rollups.added_counters(spark, f"{folder}/out").drop("late"), "window_start")


@query
def stream_histogram_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five histograms per day."""
    built = rollups.stream_histograms(*_log_streams(spark, sf_dir))
    return _ntz(_latest(spark, built, "histograms", ["metric", "labels", "window_start", "le"]), "window_start")


@query
def stream_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = rollups.stream_success_rate(D.fetch_log_from(_event_stream(spark, sf_dir)))
    return _ntz(_latest(spark, rate, "success", ["window_start"]), "window_start")


@query
def stream_histogram_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five histograms per day from parts that arrive in the wrong order, days late; no row is dropped."""
    folder = work_dir(spark, "late-histograms")
    ev = D.read_events(_streamed(spark, D.table(spark, sf_dir, "events"), "ts", newest_first=True))
    _run(rollups.histogram_observations(*_log_streams(spark, sf_dir, ev)), rollups.add_histograms(f"{folder}/out"), folder)
    return _ntz(rollups.added_histograms(spark, f"{folder}/out").drop("late"), "window_start")


@query
def stream_success_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding success rates from the same parts; no row is dropped."""
    folder = work_dir(spark, "late-rates")
    ev = D.read_events(_streamed(spark, D.table(spark, sf_dir, "events"), "ts", newest_first=True))
    _run(D.fetch_log_from(ev), rollups.add_fetches(f"{folder}/out"), folder)
    return _ntz(rollups.added_success_rate(spark, f"{folder}/out").drop("late"), "window_start")


@query
def stream_alert_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts that a stream has told: opened and resolved window by window."""
    folder = work_dir(spark, "alerts")
    rows = D.table(spark, sf_dir, "events")
    # an event a day later closes the last windows; its own stays open
    beat = rows.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr("interval 1 day"))
    ev = D.read_events(_streamed(spark, rows.unionByName(beat), "ts"))
    windows = rollups.stream_metric_windows(D.fetch_log_from(ev), D.queue_samples_from(ev), D.store_log_from(ev))
    _run(windows, stream_alerts.watch(f"{folder}/outbox", f"{folder}/state", A.default_rules(store_errors=0)), folder)
    return _flat_alerts(stream_alerts.episodes_told(spark, f"{folder}/outbox", f"{folder}/state"))


@query
def stream_http_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON request log read as a stream and classified."""
    folder = work_dir(spark, "httpstream")
    D.http_log(spark, sf_dir).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{folder}/in")
    judged = metrics.classify_http_log(httplog.read_http_log(spark, f"{folder}/in", streaming=True))
    _run(judged, S.append_changes(f"{folder}/out"), folder)
    out = S.read_changes(spark, f"{folder}/out", judged.schema)
    return out.select("request_id", "status", "level", "message", "request_body", "response_body")


def _tracked(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The change log of a job stream, and changes in its shape."""
    folder = work_dir(spark, "jobs")
    events = D.job_log_from(_event_stream(spark, sf_dir))
    _run(events, stream_jobs.add_jobs(f"{folder}/out"), folder)
    return f"{folder}/out", stream_jobs.day_states(events)


@query
def stream_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(jobs.shape_state(stream_jobs.tracked_jobs(spark, *_tracked(spark, sf_dir))), *JOB_TIMES)


@query
def stream_job_state_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of jobs submitted within a day of the newest event; days before are swept from the log."""
    log, changes = _tracked(spark, sf_dir)
    newest = S.read_changes(spark, log, changes.schema).agg(F.unix_micros(F.max("last.ts"))).first()[0]
    if newest is not None:
        stream_jobs.sweep_jobs(spark, log, newest)
    states = stream_jobs.tracked_jobs(spark, log, changes)
    return _ntz(jobs.shape_state(states.filter(stream_jobs.within(F.timestamp_micros(F.lit(newest).cast("bigint"))))), *JOB_TIMES)


@query
def stream_client_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions closed by the watermark."""
    folder = work_dir(spark, "sessions")
    asked = clients.with_client_id(D.request_log_from(_event_stream(spark, sf_dir)))
    closed = sessions.stream_sessions(asked)
    _run(closed, S.append_changes(f"{folder}/out"), folder)
    out = S.read_changes(spark, f"{folder}/out", closed.schema).drop("batch_id")
    return _ntz(out, "session_start", "last_seen", "session_end")


def _ingest(spark: SparkSession, sf_dir: str) -> str:
    """The store as batch 0 of a landing log, then captures of all documents, many entries each, streamed in and put on
    top as one crawl."""
    folder = work_dir(spark, "ingest")
    tables.append_batch(D.store_items(spark, sf_dir).select(*ITEM_SCHEMA.fieldNames()), f"{folder}/landing", 0)
    documents = _streamed(spark, D.capture_documents(spark, sf_dir), "ingest_seq")
    _run(ingest.entries(documents), ingest.offer_batches(f"{folder}/offers"), folder)
    ingest.put_offers(spark, f"{folder}/offers", f"{folder}/landing", f"{folder}/report", 1)
    return folder


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _ingest(spark, sf_dir)
    return tables.read_landed_items(spark, f"{folder}/landing").select(
        "link", "title", "author", "pub_date", "content_hash"
    )


@query
def stream_ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries, invalid, new and duplicate items over all batches."""
    report = spark.read.parquet(f"{_ingest(spark, sf_dir)}/report")
    return report.agg(*(F.sum(c).alias(c) for c in ("entries", "invalid", "new", "duplicates")))
