"""Feed-shaped tables derived from the shared test tables.

Each derivation is a DataFrame over a whole table (``documents``, ``events`` or ``pages``), so work
grows with the table.  The DuckDB side of the same derivations is in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake import constants as C
from feedlake.operators.items import accept_entries

ITEMS_NOW = "2024-07-01T00:00:00Z"
LOGS_NOW = "2024-01-31T00:00:00Z"
ENTRIES_PER_CAPTURE = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed_url(source: Column, lang: Column) -> Column:
    return F.concat(F.lit("https://"), source, F.lit(".example.org/"), lang, F.lit("/rss.xml"))


def _published(doc: Column, t: Column) -> Column:
    """Mostly RFC 1123 with numeric zone; one in thirteen is something else."""
    stamp = F.date_format(t, "E, dd MMM yyyy HH:mm:ss")
    plus2 = F.date_format(t + F.expr("interval 2 hours"), "E, dd MMM yyyy HH:mm:ss")
    odd = (
        F.when(doc % 5 == 0, F.concat(stamp, F.lit(" GMT")))
        .when(doc % 5 == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(doc % 5 == 2, F.concat(plus2, F.lit(" +0200")))
        .when(doc % 5 == 3, F.lit("some day soon"))
        .otherwise(F.lit(""))
    )
    return F.when(doc % 13 == 0, odd).otherwise(F.concat(stamp, F.lit(" +0000")))


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_items_from(table(spark, sf_dir, "documents"))


def raw_items_from(docs: DataFrame) -> DataFrame:
    """One raw entry per document."""
    doc = F.col("doc_id")
    step = F.when(F.expr("cast(substr(source, 4) as int) % 3 = 0"), 1).when(
        F.expr("cast(substr(source, 4) as int) % 3 = 1"), 30
    ).otherwise(120)
    last = F.unix_micros(F.lit("2024-06-30 23:00:00").cast("timestamp"))
    t = F.when(doc % 97 == 0, F.lit("2024-07-02 00:00:00").cast("timestamp")).otherwise(
        F.timestamp_micros(last - doc * step * C.MINUTE_US)
    )
    return docs.select(
        doc.alias("ingest_seq"),
        feed_url(F.col("source"), F.col("lang")).alias("feed_url"),
        F.concat(
            F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), doc.cast("string")
        ).alias("link"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("description"),
        F.when(doc % 11 != 0, F.concat(F.lit("author_"), (doc % 37).cast("string"))).alias("author"),
        _published(doc, t).alias("published"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted items of all documents."""
    return accept_entries(raw_items(spark, sf_dir))


def store_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yesterday's store: what was published before the last week, every seventh since re-edited."""
    old = items(spark, sf_dir).filter(F.col("pub_ts") < F.lit("2024-06-24 00:00:00").cast("timestamp"))
    edited = F.when(F.col("ingest_seq") % 7 == 0, F.concat(F.lit("[draft] "), "title")).otherwise(F.col("title"))
    return old.withColumn("title", edited).withColumn(
        "content_hash", F.md5(F.concat("title", "description", "author"))
    )


def recrawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items, every ninth once more with a corrected title, later in the same batch."""
    first = items(spark, sf_dir)
    title = F.concat("title", F.lit(" (corrected)"))
    later = first.filter(F.col("ingest_seq") % 9 == 0).withColumns({
        "title": title, "content_hash": F.md5(F.concat(title, "description", "author")), "ingest_seq": F.col("ingest_seq") + 1_000_000_000,
    })
    return first.unionByName(later)


def _xml(col: Column) -> Column:
    col = F.replace(col, F.lit("&"), F.lit("&amp;"))
    col = F.replace(col, F.lit("<"), F.lit("&lt;"))
    return F.replace(col, F.lit(">"), F.lit("&gt;"))


def capture_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS captures: the entries of one feed, at most ``ENTRIES_PER_CAPTURE`` to a document; ``ingest_seq`` is the
    number of the capture's first entry, ``numbers`` holds those of all.

    A capture covers a range of that many consecutive entry numbers, so even a feed that holds a third
    of all entries is spread over many documents.
    """
    raw = raw_items(spark, sf_dir)
    capture = F.floor(F.col("ingest_seq") / ENTRIES_PER_CAPTURE)
    grouped = raw.groupBy("feed_url", capture.alias("capture")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("ingest_seq"), _entry().alias("entry")))).alias("held")
    )
    return grouped.select(
        "feed_url", F.get("held.ingest_seq", F.lit(0)).alias("ingest_seq"), F.col("held.ingest_seq").alias("numbers"),
        F.timestamp_seconds(F.lit(1_719_792_000) + F.col("capture")).alias("fetched_at"),
        F.concat(F.lit(_OPEN), F.array_join("held.entry", ""), F.lit(_CLOSE)).alias("body"),
    )


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_documents(spark, sf_dir).drop("ingest_seq", "numbers")


# Entries in one large feed file.
ENTRIES_PER_FILE = 20_000


def write_feed_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """RSS files of many entries each, in a folder for every feed."""
    raw = raw_items(spark, sf_dir).withColumn("part", F.floor(F.col("ingest_seq") / ENTRIES_PER_FILE))
    ends = raw.select("feed_url", "part").distinct()
    lines = raw.select("feed_url", "part", "ingest_seq", _entry().alias("value"))
    for number, text in ((-1, _OPEN), (None, _CLOSE)):
        at = F.lit((1 << 63) - 1 if number is None else number).cast("bigint")
        lines = lines.unionByName(ends.select("feed_url", "part", at.alias("ingest_seq"), F.lit(text).alias("value")))
    ordered = lines.repartition("feed_url", "part").sortWithinPartitions("feed_url", "part", "ingest_seq")
    ordered.drop("ingest_seq").write.partitionBy("feed_url", "part").text(path)


def damaged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS captures of which some are cut in the middle and some are no feed."""
    turn = F.unix_seconds("fetched_at") % 4
    body = F.when(turn == 1, F.left("body", (F.length("body") / 2).cast("int"))).when(turn == 2, F.lit("503 try again later")).otherwise(F.col("body"))
    return feed_documents(spark, sf_dir).withColumn("body", body)


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture of each entry, in the format that its number asks for."""
    raw = raw_items(spark, sf_dir)

    def tag(name: str, col: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), _xml(col), F.lit(f"</{name}>"))

    written = F.to_json(F.struct(
        F.lit("https://jsonfeed.org/version/1.1").alias("version"),
        F.array(F.struct(
            F.col("link").alias("id"), F.col("link").alias("url"), "title", F.col("description").alias("summary"), F.col("published").alias("date_published"),
            F.when(F.col("author").isNotNull(), F.array(F.struct(F.col("author").alias("name")))).alias("authors"),
        )).alias("items"),
    ))
    atom = F.concat(
        F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry>'), tag("title", F.col("title")), F.lit('<link rel="self" href="x"/><link href="'), _xml(F.col("link")),
        F.lit('"/>'), tag("summary", F.col("description")), tag("published", F.col("published")),
        F.coalesce(F.concat(F.lit("<author>"), tag("name", F.col("author")), F.lit("</author>")), F.lit("")), F.lit("</entry></feed>"),
    )
    rdf = F.concat(
        F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel/><item>'), tag("title", F.col("title")), tag("link", F.col("link")),
        tag("description", F.col("description")), F.coalesce(tag("dc:creator", F.col("author")), F.lit("")), tag("dc:date", F.col("published")), F.lit("</item></rdf:RDF>"),
    )
    mailed = F.coalesce(tag("author", F.concat(F.lit("desk@example.org ("), "author", F.lit(")"))), F.lit(""))
    rss = F.concat(
        F.lit(_OPEN), F.lit("<item>"), tag("title", F.col("title")), tag("link", F.col("link")), tag("description", F.col("description")), mailed,
        tag("pubDate", F.col("published")), F.lit("</item>"), F.lit(_CLOSE),
    )
    turn = F.col("ingest_seq") % 4
    body = F.when(turn == 0, rss).when(turn == 1, atom).when(turn == 2, rdf).otherwise(written)
    return raw.select("feed_url", "ingest_seq", body.alias("body"))


_OPEN, _CLOSE = '<rss version="2.0"><channel>', "</channel></rss>"


def _entry() -> Column:
    def tag(name: str, col: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), _xml(col), F.lit(f"</{name}>"))

    author = F.concat(F.lit("<author><name>"), _xml(F.col("author")), F.lit("</name></author>"))
    return F.concat(
        F.lit("<item>"), tag("title", F.col("title")), tag("link", F.col("link")),
        tag("description", F.col("description")), F.coalesce(author, F.lit("")),
        tag("pubDate", F.col("published")), F.lit("</item>"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_events(table(spark, sf_dir, "events"))


def read_events(raw: DataFrame) -> DataFrame:
    """Events with ``ts`` as an instant and ``k`` out of the props text."""
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def log_feed_url() -> Column:
    return F.concat(F.lit("https://src"), (F.col("user_id") % 20).cast("string"), F.lit(".example.org/en/rss.xml"))


def fetch_log_from(ev: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "view", "cache_hit").otherwise("success")
    )
    return ev.select(
        "event_id", "ts", log_feed_url().alias("feed_url"), status.alias("status"),
        (F.col("value") / 100).alias("duration_s"),
        F.when(F.col("event_type") == "error", F.lit(-1)).otherwise(F.col("k")).cast("bigint").alias("items_count"),
        (F.col("event_id") % 50 == 0).alias("force_refresh"),
    )


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch_log_from(events(spark, sf_dir))


def job_log_from(ev: DataFrame) -> DataFrame:
    """Job lifecycle: submitted; all but signups then start after 1 s and end ``value`` seconds later."""
    start = F.timestamp_micros(F.unix_micros("ts") + C.SECOND_US)
    ms = F.round(F.col("value") * 1000).cast("bigint")
    end = F.timestamp_micros(F.unix_micros("ts") + C.SECOND_US + ms * 1000)
    failed = F.col("event_type") == "error"

    def step(order: int, status, ts, error, count, duration):
        return F.struct(
            F.lit(order).alias("step"), status.alias("status"), ts.alias("ts"), error.alias("error"),
            count.cast("bigint").alias("items_count"), duration.cast("bigint").alias("duration_ms"),
        )

    none, zero = F.lit(""), F.lit(0)
    submitted = step(0, F.lit("pending"), F.col("ts"), none, zero, zero)
    steps = F.when(F.col("event_type") == "signup", F.array(submitted)).otherwise(F.array(
        submitted,
        step(1, F.lit("processing"), start, none, zero, zero),
        step(
            2, F.when(failed, "failed").otherwise("completed"), end,
            F.when(failed, "fetch failed").otherwise(""), F.when(failed, 0).otherwise(F.col("k")), ms,
        ),
    ))
    return ev.select(
        F.concat(F.lit("job_"), F.col("event_id").cast("string")).alias("job_id"),
        log_feed_url().alias("url"), F.explode(steps).alias("s"),
    ).select("job_id", "url", "s.*")


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_log_from(events(spark, sf_dir))


def store_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_log_from(events(spark, sf_dir))


def store_log_from(ev: DataFrame) -> DataFrame:
    """Store operations behind the fetches: a save per live fetch (k = 99 fails), then a cache write."""
    ev = ev.filter(~F.col("event_type").isin("error", "view"))
    failed = F.col("k") == 99
    ops = F.when(failed, F.array(
        F.struct(F.lit("save").alias("operation"), F.lit("failed").alias("status"), (F.col("value") / 100).alias("duration_s")),
    )).otherwise(F.array(
        F.struct(F.lit("save").alias("operation"), F.lit("success").alias("status"), (F.col("value") / 100).alias("duration_s")),
        F.struct(F.lit("cache_set").alias("operation"), F.lit("success").alias("status"), F.lit(0.0).alias("duration_s")),
    ))
    return ev.select("ts", F.explode(ops).alias("o")).select("ts", "o.*")


def http_log_from(ev: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    post = kind.isin("purchase", "error")
    path = (
        F.when(kind == "click", "/items").when(kind == "view", "/feeds")
        .when(kind == "signup", "/job-status").otherwise("/fetch-store")
    )
    status = F.when(kind == "error", F.when(F.col("event_id") % 2 == 0, 500).otherwise(429)).otherwise(200)
    return ev.select(
        F.col("ts").alias("time"),
        F.when(post, "POST").otherwise("GET").alias("method"), path.alias("path"),
        F.concat(F.lit("limit="), F.col("k").cast("string")).alias("query"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(":40000")).alias("remote_addr"),
        F.lit("reader/1.0").alias("user_agent"),
        status.cast("int").alias("status"), F.round(F.col("value") * 10).cast("bigint").alias("duration_ms"),
        F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"),
        F.when(post, F.repeat(F.lit("{body} "), F.col("k").cast("int") * 2)).otherwise("").alias("request_body"),
        F.when(kind == "error", F.repeat(F.lit("error"), F.col("k").cast("int") * 4)).otherwise("ok").alias("response_body"),
    )


def http_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return http_log_from(events(spark, sf_dir))


def request_log_from(ev: DataFrame) -> DataFrame:
    u = F.col("user_id")
    us = u.cast("string")

    def unless(modulus: int, value: Column) -> Column:
        return F.when(u % modulus != 0, value)

    origins = F.array(*(F.lit(o) for o in ORIGINS))
    return ev.select(
        F.col("event_id").alias("request_id"), "ts",
        F.concat(F.lit("10.0."), (u % 4).cast("string"), F.lit("."), us, F.lit(":40000")).alias("remote_addr"),
        unless(5, F.concat(F.lit(" 203.0.113."), us, F.lit(" , 10.1.1.1"))).alias("x_forwarded_for"),
        unless(3, F.concat(F.lit("198.51.100."), us)).alias("x_real_ip"),
        unless(7, F.concat(F.lit(" Reader/"), (u % 4).cast("string"), F.lit(".0 (X11)"))).alias("user_agent"),
        unless(11, F.when(u % 2 == 0, "en-US,en;q=0.8").otherwise("DE")).alias("accept_language"),
        unless(13, F.concat(F.lit("sess-"), us)).alias("session_id"),
        F.element_at(origins, (F.col("event_id") % len(ORIGINS) + 1).cast("int")).alias("origin"),
        F.element_at(F.array(*(F.lit(e) for e in ENVIRONMENTS)), (u % len(ENVIRONMENTS) + 1).cast("int")).alias("environment"),
    )


ORIGINS = (
    "http://localhost:3000", "http://LOCALHOST:3000", "https://yourdomain.com", "https://api.partner.example",
    "http://partner.example", "https://partner.example.attacker.example", "https://staging.yourdomain.com",
    "https://cdn.wild.example", "https://elsewhere.example", "",
)
ENVIRONMENTS = ("development", "Prod", "stage", "unheard-of")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log_from(events(spark, sf_dir))


def queue_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue_samples_from(events(spark, sf_dir))


def queue_samples_from(ev: DataFrame) -> DataFrame:
    """A queue-depth reading per event, 0 to 50 of 50 places."""
    return ev.select(
        "ts", (F.col("k") % (C.QUEUE_CAPACITY + 1)).alias("depth"), F.lit(C.QUEUE_CAPACITY).cast("bigint").alias("capacity")
    )


URL_SHAPES = (
    "{u}", "https://news{n}.example.org/feed.xml", "ftp://files{n}.example.org/a", "http://LOCALHOST:8{n}/rss",
    "http://192.168.1.{n}/feed", "https://a{n}.example.org/setup.exe", "https://a{n}.example.org/f?q=%3CScript%3E{n}",
    "https:///feed{n}", "a{n}.example.org/feed", "//a{n}.example.org/atom", "http://172.15.0.1/{n}",
    "http://172.16.0.1/{n}", "https://a{n}.corp/rss", "http://[::1]:80/{n}", "https://a{n}.example.org/rss.php",
    "HTTPS://a{n}.example.org/xml?x=1#frag", "https://a{n}.example.org/%zz", "https://a{n}.example.org/f?q=%zz&r=a+b",
    "", "https://user@a{n}.example.org/f?next=eval(1)",
)


def url_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page URL as it is, then once in every shape the screens tell apart."""
    page = table(spark, sf_dir, "pages")
    number = (F.col("page_id") % 200).cast("string")
    shapes = F.array(*(
        F.replace(F.replace(F.lit(s), F.lit("{u}"), F.col("url")), F.lit("{n}"), number) for s in URL_SHAPES
    ))
    return page.select("page_id", F.posexplode(shapes).alias("shape", "url"))
