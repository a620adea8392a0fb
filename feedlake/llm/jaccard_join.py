"""Groups of documents linked by the Jaccard similarity of their word shingles, skipping by set relations.

1. Texts with the same shingle set form one class; only one set of each goes on.
2. Owners of hash ranges count in how many sets each shingle occurs.  A set is ordered by that count,
   rarest first, and the first ``n - ceil(t n) + 1`` places are its prefix: two sets at or above the
   similarity ``t`` share a shingle of both prefixes.  A shingle of one set only has no index list.
3. Every index list has a leader, the set with the fewest shingles of its own.  Each set of the list is
   compared with its leaders only, so a list of k sets costs k comparisons.  Linked sets form groups.
4. The lists of one leader make one index list of the sets compared with it, each with its difference
   from the leader.  A leader whose sets are all in one group by now is skipped: their answers are known.
   Elsewhere the sets outside the largest group are held against the others.  A leader's list lies in
   blocks by set size; blocks too small or too large are skipped, then sets whose place, by overlap with
   the leader and length of the difference, rules a link out.
5. What is left is derived from the leader's answers: with differences dy and dz from the leader L, the
   overlap of y and z is ``|y L| + |z L| - |L| + |dy dz|`` (over shingles that others have too), so only
   the short differences are met, never the sets.

No link between different texts is lost; within a group links that can't change it are not made.
Shingles are compared by 48-bit hashes in prefixes and overlaps, by two 64-bit sums over whole sets in
classes; a pair of sets of a thousand shingles meets a false common hash once in 10^8.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case.  Fewer words than a shingle has count as one
shingle; without words a set is empty and linked with nothing.  A null text is empty, a null doc_id is
the largest id, repeated rows are one class, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm import hashing
from feedlake.llm.shared import NO_ID, bucketed, components, map_arrow, materialise, pack_blocks, partitions, with_replies
from feedlake.llm.suffix_dedup import BITS, CODES, _blocks, add_up, hash_codes, replies_of

WORDS = 5
PERCENT = 80
BLOCK_BYTES = 3 << 20

_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9FB21C651E98DF25)


def words_of(body: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document row of every word of a block."""
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    blank = _blank[body]
    before, after = np.append(True, blank[:-1]), np.append(blank[1:], True)
    some = lengths > 0
    before[(ends - lengths)[some]] = True
    after[ends[some] - 1] = True
    first, last = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    return hashing.Rolling(_lower[body])(first, last), np.searchsorted(ends, first, "right")


def sequences(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` words in a row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = h * _STEP + words[k : k + n]
    return hashing.mix(h)


def shingle_sets(body: np.ndarray, lengths: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted set of every document of a block."""
    words, row = words_of(body, lengths)
    every = sequences(words, size)
    cuts = np.searchsorted(row, np.arange(len(lengths) + 1))
    out = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        out.append(np.unique(every[a : b - size + 1]) if b - a >= size else sequences(words[a:b], b - a) if b > a else words[:0])
    return out


def _sets(size: int):
    def sets(batches):
        for batch in batches:
            for row, body, lengths, ids in _blocks(batch):
                found = shingle_sets(body, lengths, size)
                sums = [np.array([s.sum(dtype=np.uint64), hashing.mix(s).sum(dtype=np.uint64)]).tobytes() for s in found]
                yield pa.RecordBatch.from_pydict({
                    "block_id": pa.array([row["block_id"].as_py()] * len(ids), pa.int64()), "place": pa.array(np.arange(len(ids), dtype=np.int32)),
                    "doc_id": pa.array(ids), "n": pa.array([len(s) for s in found], pa.int64()), "sums": pa.array(sums, pa.binary()),
                })

    return sets


def _chosen(row: dict, body: np.ndarray, lengths: np.ndarray, size: int):
    """The sets of a block that stand for a class, as 48-bit hashes, with their nodes."""
    chosen = sorted((c["place"], c["node"]) for c in row["chosen"].as_py() or [])
    found = shingle_sets(body, lengths, size) if chosen else []
    return [(node, len(found[place]), found[place] >> np.uint64(64 - BITS)) for place, node in chosen]


def _set_codes(owners: int, size: int):
    def codes(batches):
        for batch in batches:
            for row, body, lengths, _ in _blocks(batch):
                sets = [np.unique(s) for _, _, s in _chosen(row, body, lengths, size)]
                yield hash_codes(row["block_id"].as_py(), owners, np.concatenate([np.zeros(0, np.uint64), *sets]))

    return codes


INDEXED = "node bigint, n bigint, own bigint, prefix array<bigint>, shared binary"


def _indexed(size: int, percent: int):
    """Sets that have a prefix shingle in common with any other: prefix, and all shingles that others have."""

    def indexed(batches):
        for batch in batches:
            for row, body, lengths, _ in _blocks(batch):
                sets = _chosen(row, body, lengths, size)
                hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s for _, _, s in sets)]))
                totals = replies_of(row, "<u4")
                out = {c: [] for c in ("node", "n", "own", "prefix", "shared")}
                for node, n, s in sets:
                    count = totals[np.searchsorted(hashes, s)]
                    order = np.lexsort((s, count))
                    own, end = int(np.count_nonzero(count == 1)), n - (percent * n + 99) // 100 + 1
                    if own < end:
                        for c, v in zip(out, (node, n, own, s[order[own:end]].astype(np.int64), np.ascontiguousarray(np.sort(s[count > 1]).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())):
                            out[c].append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["node"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["own"], pa.int64()), pa.array(out["prefix"], pa.list_(pa.int64())), pa.array(out["shared"], pa.binary())],
                    list(out),
                )

    return indexed


def _unfold(cell: pa.BinaryScalar) -> np.ndarray:
    data = cell.as_buffer()
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _overlaps(batches):
    for batch in batches:
        both = [len(np.intersect1d(_unfold(x), _unfold(y), assume_unique=True)) for x, y in zip(batch.column("a_shared"), batch.column("b_shared"))]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64())], ["a", "b", "both"])


def _differences(batches):
    """What each set has and its leader lacks, or the other way round (odd), and the leader's size."""
    for batch in batches:
        differences, sizes = [], []
        for x, y in zip(batch.column("a_shared"), batch.column("b_shared")):
            x, y = _unfold(x), _unfold(y)
            more, less = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
            differences.append(np.concatenate([more * np.uint64(2), less * np.uint64(2) + np.uint64(1)]).astype(np.int64))
            sizes.append(len(y))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(differences, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["a", "b", "difference", "b_shared"])


def compared(pairs: DataFrame, indexed: DataFrame, by=_overlaps, gives: str = "both bigint") -> DataFrame:
    """Pairs (a, b) with the size of the overlap, or what else ``by`` makes of the two sets."""
    side = lambda c: indexed.select(F.col("node").alias(c), F.col("shared").alias(f"{c}_shared"))
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_shared", "b_shared")
    return pairs.join(met.transform(map_arrow, by, f"a bigint, b bigint, {gives}"), ["a", "b"])


def similar(both, a, b, percent: int):
    return 100 * both >= percent * (a + b - both)


def jaccard_groups(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id, and the number of distinct sets in the component."""
    if not 50 < percent <= 100:
        raise ValueError("the similarity is over 50 and at most 100 percent")
    n = partitions(docs.sparkSession)
    blocks = bucketed(pack_blocks(docs, block_bytes), "jaccard_blocks")
    rows = materialise(
        blocks.select("block_id", "ids", "lengths", "body").transform(map_arrow, _sets(size), "block_id bigint, place int, doc_id bigint, n bigint, sums binary")
        .withColumn("row_id", F.monotonically_increasing_id()), "jaccard-rows",
    )
    classes = materialise(
        rows.where("n > 0").groupBy("sums", "n").agg(F.min(F.struct("doc_id", "row_id", "block_id", "place")).alias("one"))
        .select("sums", "n", F.col("one.row_id").alias("node"), F.col("one.doc_id").alias("doc_id"), F.col("one.block_id").alias("block_id"), F.col("one.place").alias("place")), "jaccard-classes",
    )
    chosen = classes.groupBy("block_id").agg(F.collect_list(F.struct("place", "node")).alias("chosen"))
    sets = blocks.join(chosen.hint("shuffle_hash"), "block_id")
    codes = sets.transform(map_arrow, _set_codes(n, size), CODES).repartitionById(n, "owner")
    totals = codes.transform(map_arrow, add_up, "block_id bigint, owner int, reply binary")
    indexed = materialise(with_replies(sets, totals).transform(map_arrow, _indexed(size, percent), INDEXED), "jaccard-indexed")

    lists = indexed.select("node", "n", "own", F.posexplode("prefix").alias("at", "shingle")).withColumn("at", F.col("at") + F.col("own"))
    leaders = materialise(
        lists.groupBy("shingle").agg(F.min(F.struct("own", "n", "node")).alias("one"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
        .select("shingle", F.col("one.node").alias("b"), F.col("one.n").alias("b_n")), "jaccard-leaders",
    )
    near = lists.select("shingle", F.col("node").alias("a"), F.col("n").alias("a_n")).join(leaders, "shingle").where("a <> b")
    near = near.select("a", "b", "a_n", "b_n").distinct()
    held = materialise(compared(materialise(near, "jaccard-near"), indexed), "jaccard-held")
    links = materialise(held.where(similar(F.col("both"), F.col("a_n"), F.col("b_n"), percent)).select("a", "b", "a_n", "b_n", "both"), "jaccard-links")
    groups = components(links, "jaccard-groups")
    more = _between_groups(indexed, groups, held, percent)
    groups = components(links.select("a", "b").unionByName(more), "jaccard-groups")

    joined = classes.join(groups, "node", "left").select("sums", "n", "doc_id", F.coalesce("component", "node").alias("component"))
    named = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    answer = materialise(joined.select("sums", "n", "component").join(materialise(named, "jaccard-named"), "component").drop("component"), "jaccard-answer")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.join(answer, ["sums", "n"], "left").select(
        known("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, known("component_id")).otherwise(known("doc_id")).alias("component_id"),
        F.coalesce("sets", F.lit(1).cast("bigint")).alias("sets"),
    )


def _between_groups(indexed: DataFrame, groups: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets that the leaders have not brought together."""
    component = lambda c, name: groups.select(F.col("node").alias(c), F.col("component").alias(name))
    # a leader is on its own list, without a difference
    own = held.select(F.col("b").alias("a"), "b", F.col("b_n").alias("a_n"), "b_n").distinct().withColumn("both", F.lit(None).cast("bigint"))
    listed = held.select("a", "b", "a_n", "b_n", "both").unionByName(own).join(component("a", "known"), "a", "left")
    listed = materialise(listed.withColumn("group", F.coalesce("known", "a")).drop("known"), "jaccard-listed")
    sizes = listed.groupBy("b", "group").agg(F.count(F.lit(1)).alias("sets")).groupBy("b").agg(
        F.max_by("group", F.struct("sets", "group")).alias("largest"), F.count(F.lit(1)).alias("groups")
    )
    mixed = materialise(sizes.where("groups > 1").select("b", "largest"), "jaccard-mixed")
    if mixed.isEmpty():
        return held.select("a", "b").limit(0)
    lists = materialise(listed.join(mixed, "b"), "jaccard-lists")
    made = compared(lists.select("a", "b", "a_n", "both", "group", "largest"), indexed, _differences, "difference array<bigint>, b_shared bigint")
    # ranges of sizes by the ratio that links allow: partners are in this one or the next
    size = F.floor(F.log(F.col("a_n").cast("double")) / F.log(F.lit(100 / percent + 1e-9)))
    made = materialise(made.withColumn("both", F.coalesce("both", "b_shared")).withColumn("range", size), "jaccard-differences")
    side = lambda c: [F.col(k).alias(f"{c}_{k}") for k in ("both", "group", "difference")]
    x = made.where("group <> largest").select(
        F.col("b").alias("leader"), F.col("a").alias("x"), F.col("a_n").alias("x_n"), *side("x"), "b_shared", F.explode(F.array(F.col("range") - 1, F.col("range"), F.col("range") + 1)).alias("range")
    )
    y = made.select(F.col("b").alias("leader"), "range", F.col("a").alias("y"), F.col("a_n").alias("y_n"), *side("y"), (F.col("group") != F.col("largest")).alias("y_outside"))
    through = F.col("x_both") + F.col("y_both") - F.col("b_shared")
    in_reach = (
        (F.col("x_group") != F.col("y_group")) & (~F.col("y_outside") | (F.col("x") < F.col("y")))
        & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
        & similar(through + F.least(F.size("x_difference"), F.size("y_difference")), F.col("x_n"), F.col("y_n"), percent)
    )
    met = through + F.size(F.array_intersect("x_difference", "y_difference"))
    linked = F.when(in_reach, similar(met, F.col("x_n"), F.col("y_n"), percent)).otherwise(False)
    return materialise(x.join(y, (x.leader == y.leader) & (x.range == y.range) & linked).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "jaccard-more")
