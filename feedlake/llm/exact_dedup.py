"""Exact duplicates by a Golomb-coded exchange of fingerprints.

1. Every partition sends the sorted 64-bit fingerprints of its texts, Golomb-Rice coded, to the
   owners of hash ranges.
2. An owner merges what it got and answers each sender with a bitmap: seen more than once, or not.
3. Only rows with a set bit are suspects.  Their ids make a bit table of fixed size, which is broadcast
   and holds the other rows' texts back where they are; more suspects only let more texts through.
4. The suspects' texts are shuffled and compared byte for byte by grouping on the text itself, which
   combines equal texts before the shuffle, so a group of any size is one row per map task.

Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``.  Of equal texts the row
with the most code points stays, then the least doc_id (null last), then the first row read.  A null
text counts as empty; repeated doc_ids are separate rows; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm import hashing
from feedlake.llm.shared import map_arrow, materialise, next_block_id, partitions

BLANKS = " \t\n\x0b\x0c\r"
# The bit table has WORDS words of 64 bits: at most so many rows are broadcast, whatever the input.
WORDS = 1 << 18


def _codes(owners: int):
    def encode(batches):
        numbers = next_block_id()
        for batch in batches:
            prints = np.frombuffer(b"".join(x[:8] for x in batch.column("sha").to_pylist()), ">u8").astype(np.uint64)
            if not len(prints):
                continue
            order = np.argsort(prints, kind="stable")
            rows, prints = batch.column("row_id").to_numpy()[order], prints[order]
            block = next(numbers)
            parts = hashing.split_by_owner(prints, owners, 64)
            yield pa.RecordBatch.from_pydict({
                "block_id": pa.array([block] * len(parts), pa.int64()), "owner": pa.array([p[0] for p in parts], pa.int32()),
                "low": pa.array([str(p[3]) for p in parts]),
                "code": pa.array([hashing.rice_encode(prints[a:b], low) for _, a, b, low in parts], pa.binary()),
                "row_ids": pa.array([rows[a:b].tobytes() for _, a, b, _ in parts], pa.binary()),
            })

    return encode


def _repeats(batches):
    """An owner's answer to every sender, once all have been read."""
    keys, decoded = [], []
    for batch in batches:
        for block, owner, low, code in zip(*(batch.column(c).to_pylist() for c in ("block_id", "owner", "low", "code"))):
            keys.append((block, owner))
            decoded.append(hashing.rice_decode(code, int(low)))
    if not keys:
        return
    every = np.sort(np.concatenate(decoded))
    repeated = every[1:][every[1:] == every[:-1]]
    answers = [np.packbits(np.isin(x, repeated)).tobytes() for x in decoded]
    yield pa.RecordBatch.from_pydict({
        "block_id": pa.array([k[0] for k in keys], pa.int64()), "owner": pa.array([k[1] for k in keys], pa.int32()),
        "seen": pa.array(answers, pa.binary()),
    })


def _suspects(batches):
    for batch in batches:
        out = [np.zeros(0, np.int64)]
        for rows, seen in zip(batch.column("row_ids").to_pylist(), batch.column("seen").to_pylist()):
            rows = np.frombuffer(rows, np.int64)
            out.append(rows[np.unpackbits(np.frombuffer(seen, np.uint8), count=len(rows)).astype(bool)])
        yield pa.RecordBatch.from_pydict({"row_id": pa.array(np.concatenate(out), pa.int64())})


def _place(doc_id):
    """Word and bit of an id in the table."""
    print_ = F.xxhash64(doc_id)
    return F.pmod(print_, F.lit(WORDS)), F.pmod(F.shiftright(print_, 32), F.lit(64)).cast("int")


def exact_groups(docs: DataFrame, carry: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and a column to carry along."""
    carried = [carry] if carry else []
    spark = docs.sparkSession
    normal = F.translate(F.coalesce("text", F.lit("")), BLANKS, "")
    marks = materialise(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("bigint").alias("doc_id"),
            F.unhex(F.sha2(normal, 256)).alias("sha"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("points"),
            *(F.col(c).alias("carried") for c in carried),
        ), "exact-marks",
    )
    n = partitions(spark)
    codes = materialise(
        marks.select("row_id", "sha").transform(map_arrow, _codes(n), "block_id bigint, owner int, low string, code binary, row_ids binary"), "exact-codes"
    )
    answers = codes.select("block_id", "owner", "low", "code").repartitionById(n, "owner").transform(map_arrow, _repeats, "block_id bigint, owner int, seen binary")
    found = codes.select("block_id", "owner", "row_ids").join(answers, ["block_id", "owner"]).select("row_ids", "seen").transform(map_arrow, _suspects, "row_id bigint")
    suspects = materialise(marks.join(found, "row_id", "left_semi"), "exact-suspects")

    wanted = suspects.select(F.col("doc_id").alias("wanted")).distinct()
    word, bit = _place(F.col("wanted"))
    table = materialise(wanted.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits")), "exact-table")
    word, bit = _place(F.col("doc_id"))
    held = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("word", word)
    held = held.join(F.broadcast(table), "word").where(F.call_function("shiftrightunsigned", "bits", bit).bitwiseAND(1) == 1)
    # written, as the optimiser would else make the semi-join first, and shuffle all texts for it
    held = materialise(held.select("doc_id", "text"), "exact-texts")
    texts = held.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    verified = (
        texts.groupBy(normal.alias("normal")).agg(F.count(F.lit(1)).alias("rows"))
        .groupBy(F.unhex(F.sha2("normal", 256)).alias("sha")).agg(F.count(F.lit(1)).alias("texts"))
    )
    best = F.min(F.struct((-F.col("points")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id"))
    groups = suspects.groupBy("sha").agg(best.alias("best"), F.count(F.lit(1)).alias("size")).join(verified, "sha").select(
        "sha", F.when(F.col("texts") == 1, F.col("best")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest"))).alias("best"), "size",
    )
    groups = materialise(groups, "exact-groups")
    return marks.join(groups, "sha", "left").select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("best.row_id") == F.col("row_id"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), *(F.col("carried").alias(c) for c in carried),
    )
