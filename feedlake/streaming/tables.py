"""Stream sinks on plain parquet that survive replayed batches.

A micro-batch writes exactly one directory named by its batch id and overwrites it when replayed.
Two shapes: a *change log* (every batch appends the rows that changed; readers take the last per key)
and a *versioned state* (every batch writes the whole, small state, built from the version before).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from feedlake.operators.dedupe import last_per


def start(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", once: bool = True
) -> StreamingQuery:
    """Run ``each`` per micro-batch; ``once`` works off what is there and stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_changes(path: str, *parts: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: one folder for each batch, partitioned by ``parts``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.hint("rebalance", *parts) if parts else batch
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*parts).parquet(f"{path}/batch_id={batch_id}")

    return each


def read_changes(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    full = StructType([*schema.fields]).add("batch_id", "long")
    return spark.read.schema(full).parquet(path)


def read_latest(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """Last version of every key in a change log."""
    return last_per(read_changes(spark, path, schema), keys, "batch_id").drop("batch_id")


def version_path(path: str, batch_id: int) -> str:
    return f"{path}/version={batch_id}"


def read_version(spark: SparkSession, path: str, batch_id: int, schema: StructType | str) -> DataFrame:
    """State as of ``batch_id``.  Only the state before the first batch, -1, is empty: a later version
    that is missing was lost, and reading it raises."""
    if batch_id < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(version_path(path, batch_id))


def newest_version(spark: SparkSession, path: str) -> int:
    """Id of the last version written under ``path``; -1 when there is none yet."""
    return spark.read.schema("version bigint").parquet(path).agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]
