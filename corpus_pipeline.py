"""The training-text pipeline: five stages over ``documents``, each written and read again by the next.

Every stage works on all rows that its predecessor kept.  Rows are told apart by a number of their own,
not by doc_id, so repeated or null ids lose no row and keep none too many.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm import bpe, decontaminate, exact_dedup, jaccard_join, toxicity
from feedlake.llm.registry import bpe_digests
from feedlake.llm.shared import materialise, small_side, table

def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number each in a column of a new name, written so that it stays theirs."""
    row = f"row_{uuid.uuid4().hex}"
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row


def without(rows: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """The rows whose numbers aren't in ``dropped``."""
    return rows.join(small_side(materialise(dropped, "pipeline-dropped")), row, "left_anti").drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half or more go."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for blanks, one row stays."""
    rows, row = numbered(docs)
    return without(rows, exact_dedup.exact_groups(rows, row).where("not kept").select(row), row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the least doc_id stays (null last)."""
    rows, row = numbered(docs)
    groups = jaccard_join.jaccard_groups(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    members = materialise(groups.join(rows.select(row, "doc_id"), row), "pipeline-members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row))
    kept = members.groupBy("component_id").agg(first.alias("first")).select(F.col(f"first.{row}").alias(row))
    return without(rows, members.select(row).join(kept.hint("shuffle_hash"), row, "left_anti"), row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    return bpe_digests(bpe.encode_documents(docs, bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

# Learned scores and merge ranks have no SQL form; tests/llm/test_pipeline.py checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
