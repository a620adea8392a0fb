"""Table schemas."""

from pyspark.sql import types as T

FEED_SOURCE = T.StructType([T.StructField("name", T.StringType()), T.StructField("url", T.StringType())])

# Raw entry of a feed document, before any cleaning.
RAW_ENTRY_FIELDS = ("title", "link", "description", "author", "published")

ITEM_TEXT = ("title", "link", "description", "author", "pub_date")

ITEM = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("feed_url", *ITEM_TEXT)]
    + [
        T.StructField("pub_ts", T.TimestampType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("ingest_seq", T.LongType()),
    ]
)

FEED_DOCUMENT = T.StructType([
    T.StructField("feed_url", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("body", T.StringType()),
])

HTTP_LOG = T.StructType([
    T.StructField("time", T.TimestampType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("remote_addr", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("request_body", T.StringType()),
    T.StructField("response_body", T.StringType()),
])
