"""Folders of tables, through the file system that Spark itself uses for their path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    files, place = _at(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write of the whole folder has ended."""
    files, place = _at(spark, f"{path}/_SUCCESS")
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)
