"""The sink of keyed puts: a batch of items into the landing log of :mod:`feedlake.sources.items`.

A put reads the buckets of its own links and writes to them, so its cost follows the batch.  It can be
repeated: the batch's partitions are overwritten by the same rows, found against the batches before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.operators.dedupe import drop_known
from feedlake.schemas import ITEM
from feedlake.sources.items import BUCKET_BATCHES, append_batch, bucket_of, buckets_in, latest, merge_buckets, read_buckets


def put_items(items: DataFrame, path: str, number: int, dedupe: bool = True, merge_after: int = BUCKET_BATCHES) -> DataFrame:
    """Put a batch: same link replaced, new link added; one row of counts, ``put`` and ``replaced_in_batch``
    (rows that a later one of the batch replaces).

    With ``dedupe`` items that duplicate what is stored are left out.  Batches are numbered from 0 on.  Rows
    arrive in the order of ingest_seq and, within one, of ``position`` where there is one.
    """
    spark = items.sparkSession
    if "position" not in items.columns:
        items = items.withColumn("position", F.lit(0))
    offered = items.select(*ITEM.fieldNames(), "position", F.struct("ingest_seq", "position").alias("arrival"))
    links = offered.select("link").distinct()
    # no more numbers than the log has buckets
    count = buckets_in(spark, path)
    buckets = [r.bucket for r in links.select(bucket_of(F.col("link"), count).alias("bucket")).distinct().collect()]
    survivors = offered
    if dedupe and number > 0:
        landed = read_buckets(spark, path, buckets).filter(F.col("batch_id") < number)
        stored = landed.select("link", "title", "author", "content_hash", "ingest_seq", "position", "batch_id")
        survivors = drop_known(offered, latest(stored.join(links, "link", "left_semi")), "arrival")
    append_batch(survivors.drop("arrival"), path, number)
    counts = put_counts(spark, path, buckets, number)
    merge_buckets(spark, path, buckets, number, merge_after)
    return counts


def put_counts(spark: SparkSession, path: str, buckets: list[int], number: int) -> DataFrame:
    """What a batch has put, from the log."""
    put = read_buckets(spark, path, buckets).filter(F.col("batch_id") == number)
    row = put.agg(F.count(F.lit(1)).alias("put"), (F.count(F.lit(1)) - F.count_distinct("link")).alias("replaced_in_batch")).first()
    return spark.createDataFrame([tuple(row)], "put bigint, replaced_in_batch bigint")
