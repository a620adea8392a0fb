"""Item tables on parquet.

Plain Spark tables:

* a *landing log*, appended batch by batch, with partitions by a hash bucket of the link and ``batch_id``.
  The number of buckets follows the number of links (``BUCKET_ROWS`` to a bucket), and a bucket whose
  batches have piled up is merged, so what a batch of k links reads is k buckets of bounded size at most,
  whatever the length of the history.  A replayed batch overwrites its own partitions;
* a *serving table*, one row per link, partitioned by publication day (or month) with links sorted
  inside files, so date filters (on a scan with ``parts``) skip directories and link ranges skip row
  groups; beside it *lookup tables* with the same rows, sorted by another column.

The log under ``path`` lies in ``of=N`` for N buckets.  The largest N that a doubling has completed counts; doubling
N writes ``of=2N`` whole before ``of=N`` goes.  Merging a bucket adds the merged rows to its newest merged batch
before the older batches go: a link found twice has the same last version twice, so a run that ends in
between leaves nothing wrong.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.operators.dedupe import last_per_link
from feedlake.operators.retention import survives
from feedlake.schemas import ITEM
from feedlake.session import stored
from feedlake.sources.files import folder_names, is_complete, remove

FIRST_BUCKETS = 16
BUCKET_ROWS = 200_000
# batches a bucket may hold before it is merged
BUCKET_BATCHES = 8

LANDED = T.StructType([*ITEM.fields, T.StructField("position", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("batch_id", T.LongType())])


def bucket_of(link: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(link), F.lit(buckets)).cast("int")


def buckets_in(spark: SparkSession, path: str) -> int:
    """Number of buckets of the log."""
    found = [int(n[3:]) for n in folder_names(spark, path) if n.startswith("of=") and is_complete(spark, f"{path}/{n}")]
    return max(found, default=FIRST_BUCKETS)


def append_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch of the landing log; a replay of the same batch replaces it."""
    if "position" not in batch.columns:
        batch = batch.withColumn("position", F.lit(0))
    buckets = buckets_in(batch.sparkSession, path)
    parts = batch.withColumn("bucket", bucket_of(F.col("link"), buckets)).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    writer = parts.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket", "batch_id").parquet(f"{path}/of={buckets}")


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDED).parquet(f"{path}/of={buckets_in(spark, path)}")


def read_buckets(spark: SparkSession, path: str, buckets: Iterable[int]) -> DataFrame:
    """The rows of some buckets; other folders aren't even listed."""
    root = f"{path}/of={buckets_in(spark, path)}"
    there = [f"{root}/bucket={b}" for b in buckets if folder_names(spark, f"{root}/bucket={b}")]
    if not there:
        return spark.createDataFrame([], LANDED)
    return spark.read.schema(LANDED).option("basePath", root).parquet(*there)


def latest(log: DataFrame) -> DataFrame:
    """Current version of every link."""
    return last_per_link(log, "batch_id", "ingest_seq", "position")


def read_landed_items(spark: SparkSession, path: str) -> DataFrame:
    return latest(read_landing(spark, path)).drop("bucket", "batch_id", "position")


def merge_buckets(spark: SparkSession, path: str, buckets: Iterable[int], before_batch: int, most: int = BUCKET_BATCHES) -> None:
    """Merge those of ``buckets`` that hold more than ``most`` batches, and double the number of buckets as long as a
    merged one is too large.  Batches from ``before_batch`` on stay as they are, so they can be replayed."""
    count = buckets_in(spark, path)
    root = f"{path}/of={count}"
    older = {b: sorted(int(n[9:]) for n in folder_names(spark, f"{root}/bucket={b}") if n.startswith("batch_id=") and int(n[9:]) < before_batch) for b in buckets}
    full = {b: batches for b, batches in older.items() if len(batches) > most}
    if not full:
        return
    last = F.create_map(*(F.lit(x) for b, batches in full.items() for x in (b, batches[-1])))
    rows = read_buckets(spark, path, full).filter(F.col("batch_id") < before_batch)
    merged = latest(rows).withColumn("batch_id", last[F.col("bucket")].cast("bigint"))
    merged.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket", "batch_id").parquet(root)
    for b, batches in full.items():
        for batch in batches[:-1]:
            remove(spark, f"{root}/bucket={b}/batch_id={batch}")
    largest = read_buckets(spark, path, full).groupBy("bucket").count().agg(F.max("count")).first()[0]
    factor = 1
    while largest > 2 * factor * BUCKET_ROWS:
        factor *= 2
    if factor > 1:
        wider = f"{path}/of={count * factor}"
        remove(spark, wider)  # what a run that ended early may have left
        moved = read_landing(spark, path).withColumn("bucket", bucket_of(F.col("link"), count * factor))
        moved.hint("rebalance", "bucket").write.option("partitionOverwriteMode", "static").partitionBy("bucket", "batch_id").parquet(wider)
        if not is_complete(spark, wider):
            raise RuntimeError("the cluster doesn't mark complete writes (_SUCCESS), which doubling the buckets needs")
        remove(spark, root)


def part_of(pub_ts: Column, unit: str) -> Column:
    """Start of the day or month an item was published in: the partition it is kept in."""
    if unit not in ("day", "month"):
        raise ValueError(f"unknown partition unit {unit!r}")
    return F.to_date(F.date_trunc(unit, pub_ts))


def write_items(items: DataFrame, path: str, unit: str = "day", max_records_per_file: int = 1_000_000) -> None:
    """Serving layout.  The rebalance hint lets the runtime split a partition that holds too much
    (items with an unreadable date all share one day).  Sparse tables are better off by month."""
    parts = items.withColumn("pub_part", part_of(F.col("pub_ts"), unit))
    (
        parts.hint("rebalance", "pub_part").sortWithinPartitions("pub_part", "link")
        .write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("pub_part").parquet(path)
    )


GROUP_BYTES = 16 << 20


def write_lookup(items: DataFrame, path: str, by: str = "author", group_bytes: int = GROUP_BYTES) -> None:
    """A second layout of the items for equality on ``by`` and on the link: rows sorted by ``by`` over all files, so
    the least and greatest values of row groups tell most of them apart, and a Bloom filter of the links in
    every row group.  Ranges are of equal size, however many rows one value has."""
    ranges = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        items.select(*ITEM.fieldNames()).repartitionByRange(ranges, by, "link").sortWithinPartitions(by, "link")
        .write.mode("overwrite").option("parquet.block.size", group_bytes)
        .option("parquet.bloom.filter.enabled#link", "true").parquet(path)
    )


def scan_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEM).parquet(path)


def _serving(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEM.fromJson(ITEM.jsonValue()).add("pub_part", "date")).parquet(path)


def scan_items(spark: SparkSession, path: str, keys_only: bool = False, parts: bool = False) -> DataFrame:
    """Stored items; with ``parts`` also ``pub_part``, which date filters and keyset pages then bound."""
    items = _serving(spark, path)
    if keys_only:
        return items.select("link")
    return items if parts else items.drop("pub_part")


def expire_items(spark: SparkSession, path: str, before: Column, unit: str = "day") -> DataFrame:
    """Retention in place: drop what ``survives`` of :mod:`feedlake.operators.retention` doesn't keep; one row with
    kept and deleted counts.

    Only the partition that the cutoff falls into is written anew, from a copy of its survivors and in one
    commit; then the partitions wholly before it go as folders.  Others aren't touched.  A run that fails
    before that commit changes nothing, one that fails after it is completed by the next.
    """
    first = spark.range(1).select(part_of(before, unit).alias("day")).first().day
    table = _serving(spark, path)
    old = [n for n in folder_names(spark, path) if n.startswith("pub_part=") and n[9:] < first.isoformat()]
    # row counts by partition come from file footers
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).first().n
    dropped = count(table.filter(F.col("pub_part") < F.lit(first)))
    boundary = table.filter(F.col("pub_part") == F.lit(first))
    expired = count(boundary.filter(~survives(before)))
    if expired:
        survivors = stored(boundary.filter(survives(before)), "boundary")
        name = f"pub_part={first.isoformat()}"
        if survivors.isEmpty():
            old.append(name)
        else:
            ordered = survivors.hint("rebalance", "pub_part").sortWithinPartitions("link")
            ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pub_part").parquet(path)
    for name in old:
        remove(spark, f"{path}/{name}")
    kept = count(_serving(spark, path))
    return spark.createDataFrame([(kept, dropped + expired)], "kept bigint, deleted bigint")
