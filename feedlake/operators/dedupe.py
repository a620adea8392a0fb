"""Duplicate detection and keyed upsert.

Copies may be very uneven: one link or one text can hold a third of all rows.  Every grouping here is
an aggregate with map-side combine (min, max, max_by), so copies collapse before the shuffle.  Where its
result meets full rows again it is written first: the runtime splits a hot key only if both sides of the
join are plain shuffles, not an aggregate above one.  No step pairs the members of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake import constants as C
from feedlake.session import stored as stored_side


def existing_by_link(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """Each incoming item with the stored item of the same link in ``stored`` (NULL when new)."""
    stored = store.select("link", F.struct("title", "author", "pub_date", "content_hash").alias("stored"))
    return incoming.join(stored, "link", "left")


def drop_known(incoming: DataFrame, store: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Incoming items that are not duplicates of what is stored.

    The stored witness for a content hash is the stored row of the *last* incoming item with that hash
    whose link is stored; an item is dropped when it equals its witness in link, in title and author,
    or in hash.
    """
    stored = store.select(
        "link", F.struct("link", "title", "author", "content_hash").alias("witness")
    )
    probes = incoming.groupBy("link", "content_hash").agg(F.max(seq).alias("last_seq"))
    witnesses = (
        probes.join(stored, "link")
        .groupBy("content_hash")
        .agg(F.max_by("witness", "last_seq").alias("w"))
    )
    witnesses = stored_side(witnesses, "witnesses")
    same = (
        (F.col("link") == F.col("w.link"))
        | ((F.col("title") == F.col("w.title")) & (F.col("author") == F.col("w.author")))
        | (F.col("content_hash") == F.col("w.content_hash"))
    )
    known = F.coalesce(same, F.lit(False))
    return incoming.join(witnesses, "content_hash", "left").filter(~known).select(*incoming.columns)


def last_per(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row per key.  ``row_number = 1`` lets Spark cut each task's copies before the shuffle."""
    latest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank")


def last_per_link(items: DataFrame, *order: str) -> DataFrame:
    return last_per(items, ["link"], *order)


def upsert_items(
    store: DataFrame, incoming: DataFrame, dedupe: bool = True, seq: str = "ingest_seq"
) -> DataFrame:
    """The table after a keyed put of ``incoming``: same link replaced, new link added.

    With ``dedupe`` only the survivors of :func:`drop_known` are put.  Within the batch the last row
    per link wins.
    """
    put = drop_known(incoming, store, seq) if dedupe else incoming
    tagged = store.withColumn("_put", F.lit(False)).withColumn("_seq", F.lit(None).cast("bigint")).unionByName(
        put.select(*store.columns, F.lit(True).alias("_put"), F.col(seq).cast("bigint").alias("_seq"))
    )
    return last_per_link(tagged, "_put", "_seq").select(*store.columns)


def upsert_counts(store: DataFrame, incoming: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """One row: rows offered, rows put, and rows of the batch overwritten by a later one."""
    survivors = drop_known(incoming, store, seq)
    return survivors.agg(
        F.count(F.lit(1)).alias("put"),
        (F.count(F.lit(1)) - F.count_distinct("link")).alias("replaced_in_batch"),
    ).select(
        incoming.agg(F.count(F.lit(1)).alias("n")).scalar().alias("offered"), "put", "replaced_in_batch"
    )


def duplicate_pairs(items: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Every item that duplicates an earlier one, paired with the first of its group, with the reasons.

    Three equalities make three groupings (link; title and author; content hash); a literal OR join
    would be a nested loop.  Pairs run from each member to the first of its group, so their number is
    linear in the rows however large a group is.
    """

    def to_first(keys: list[str], reason: str) -> DataFrame:
        first = items.groupBy(*keys).agg(F.min(seq).alias("first_seq"), F.count(F.lit(1)).alias("n"))
        members = items.select(*keys, F.col(seq).alias("duplicate_seq"))
        return (
            members.join(stored_side(first.filter("n > 1").drop("n"), "firsts"), keys)
            .filter("duplicate_seq <> first_seq")
            .select("first_seq", "duplicate_seq", F.lit(reason).alias("reason"))
        )

    pairs = (
        to_first(["link"], "link")
        .unionByName(to_first(["title", "author"], "title_author"))
        .unionByName(to_first(["content_hash"], "content_hash"))
    )
    reasons = ("link", "title_author", "content_hash")
    return (
        pairs.groupBy("first_seq", "duplicate_seq")
        .agg(*(F.max(F.col("reason") == r).alias(r) for r in reasons))
        .select(
            "first_seq", "duplicate_seq",
            F.concat_ws(",", *(F.when(F.col(r), r) for r in reasons)).alias("reasons"),
        )
    )


def duplicate_groups(items: DataFrame) -> DataFrame:
    """Sizes of the title-and-author and content groups that hold more than one item."""

    def sizes(keys: list[str], reason: str) -> DataFrame:
        return (
            items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .groupBy("n").agg(F.count(F.lit(1)).alias("groups"))
            .select(F.lit(reason).alias("reason"), F.col("n").alias("members"), "groups")
        )

    return sizes(["title", "author"], "title_author").unionByName(sizes(["content_hash"], "content_hash"))


def batch_size(count: Column, configured: int = 0) -> Column:
    """Rows per write: the configured size when positive, else by the number of items."""
    if configured > 0:
        return F.lit(configured)
    size = None
    for top, rows in C.BATCH_STEPS:
        size = F.when(count <= top, rows) if size is None else size.when(count <= top, rows)
    return size.otherwise(C.BATCH_BEYOND)


def batch_plan(items: DataFrame, configured: int = 0) -> DataFrame:
    """Per feed: items, rows per write and number of writes."""
    counts = items.groupBy("feed_url").agg(F.count(F.lit(1)).alias("items"))
    sized = counts.withColumn("batch_size", batch_size(F.col("items"), configured).cast("bigint"))
    return sized.withColumn("n_batches", F.ceil(F.col("items") / F.col("batch_size")))


def configured_batch_size(*sizes: int) -> int:
    """First of the given sizes when positive, else 0 (adaptive)."""
    return sizes[0] if sizes and sizes[0] > 0 else 0
