"""Structured request log: JSON lines, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedlake.schemas import HTTP_LOG


def read_http_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(HTTP_LOG).json(path)
