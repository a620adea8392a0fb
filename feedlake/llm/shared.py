"""What the operators of this subpackage share: written intermediates, text blocks, links to groups.

Intermediates are Parquet tables in the folder all executors share, so a lost executor costs the
tasks it held and nothing else.
"""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A null document id counts as the largest id.
NO_ID = np.iinfo(np.int64).max
BLOCK_BYTES = 4 << 20
BLOCK_SCHEMA = "block_id bigint, n int, ids binary, lengths binary, body binary"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or one inside the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch").rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and fixes its row ids."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of ids that may be broadcast: 16 bytes each, some tens of MB with their table.
BROADCAST_ROWS = 400_000


def small_side(written: DataFrame) -> DataFrame:
    """A written table of narrow rows as a join's side: broadcast if it has few rows, else by hash."""
    few = written.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(written) if few else written.hint("shuffle_hash")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per session, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_feedlake_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    target = os.path.join(tempfile.mkdtemp(prefix="feedlake-"), "feedlake_package.zip")
    with open(target, "wb") as out:
        out.write(packed.getvalue())
    context.addPyFile(target)
    context._feedlake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, task, schema: str) -> DataFrame:
    """``df.mapInArrow`` whose tasks hand the memory they have freed back to the system: a worker lives on
    between tasks, and what its allocators keep would stay beside the next operator's."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row bounds (n + 1) and bytes of a string column; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bounds - bounds[0], body[bounds[0] : bounds[-1]]


def next_block_id() -> Iterator[int]:
    """Ids that no other task of the same job gives out."""
    k = TaskContext.get().partitionId() << 32
    while True:
        yield k
        k += 1


def pack_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of many whole documents each; a longer document has a block of its own.

    ``docs`` has doc_id (null: NO_ID) and text (null: empty).  Blocks differ between runs of a plan,
    so materialise them before they are read twice.
    """

    def pack(batches):
        numbers = next_block_id()
        ids, bodies, size = [], [], 0

        def block():
            lengths = np.array([len(x) for x in bodies], np.int64)
            return pa.RecordBatch.from_pydict({
                "block_id": pa.array([next(numbers)], pa.int64()), "n": pa.array([len(ids)], pa.int32()),
                "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                "lengths": pa.array([lengths.tobytes()], pa.binary()), "body": pa.array([b"".join(bodies)], pa.binary()),
            })

        for batch in batches:
            keys = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            bounds, body = utf8(batch.column(1))
            for row, key in enumerate(keys):
                text = body[bounds[row] : bounds[row + 1]].tobytes()
                if ids and size + len(text) > block_bytes:
                    yield block()
                    ids, bodies, size = [], [], 0
                ids.append(key)
                bodies.append(text)
                size += len(text)
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).transform(map_arrow, pack, BLOCK_SCHEMA)


def bucketed(blocks: DataFrame, label: str) -> DataFrame:
    """The blocks as a table bucketed by block_id: later joins move only the other side."""
    spark = blocks.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    blocks.write.option("compression", "zstd").bucketBy(partitions(spark), "block_id").saveAsTable(name)
    return spark.table(name)


def with_replies(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Every block with what owners sent back for it, at most one reply of each owner."""
    gathered = replies.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("owner", "reply"))).alias("replies"))
    return blocks.join(gathered.hint("shuffle_hash"), "block_id", "left")


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); a component is named by its least node.

    Every round each node takes the least label among its neighbours' and then the label of that
    label, so labels travel ever longer ways.  Rounds end when nothing changes.
    """
    both = materialise(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), label
    )
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), label)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        nearer = materialise(
            labels.join(near, labels.node == near.a, "left").select(
                "node", "component", F.least("component", F.coalesce("near", "component")).alias("next")
            ), label,
        )
        short = F.least("next", F.coalesce("short", "next"))
        step = materialise(
            nearer.join(nearer.select(F.col("node").alias("root"), F.col("next").alias("short")), F.col("next") == F.col("root"), "left").select(
                "node", short.alias("component"), (F.col("component") != short).alias("moved")
            ), label,
        )
        labels = step.select("node", "component")
        if step.where("moved").isEmpty():
            return labels
