"""The trie of conversation prefixes, built as a burst trie.

A turn is an id of 20 bytes: half a SHA-256 of role and text, and the text's length.  A conversation is the
string of its turns' ids; equal conversations are one string with a count before anything else is done.

Strings lie in containers, each under a head: a prefix that all its strings share.  The root's container is
burst at once.  A container of more than LIMIT strings is burst as well: its head moves down to the longest
prefix its strings have in common, and each string goes to the container of its next turn.  This goes on
until no container is too large, so a frequent first turn or a long common opening is dealt out over its
continuations.  The containers that remain are sorted and swept: a pass over the sorted strings keeps the
open nodes on a stack, and closes those that the next string does not share.  Sums over the containers
then go up through the heads, one level of bursts after the other.

The ids of the conversations that end at a node are sorted over all tasks, packed into texts of PACK ids
and only these are hashed in a row.

A conversation's turns are one row of 20 bytes a turn; everything else is bounded by LIMIT, PACK or the
length of one conversation.  Rows without conv_id belong to no conversation and are left out; turns of
equal number are ordered by their ids; null role and text are empty; repeated rows are turns like any
other; extra columns are ignored; an empty table gives no rows.  c % 100 keeps the sign of c.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.shared import map_arrow, materialise, partitions

TURN = 20
# Strings that a container holds at most, and ids in one text to be hashed.
LIMIT = 256
PACK = 4096
SHARED = 6
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends binary"


def half_digest(column: Column) -> Column:
    return F.unhex(F.substring(F.sha2(column, 256), 1, 32))


def piece(column: Column, first: Column | int, turns: Column | int) -> Column:
    """``turns`` turns from the turn ``first`` (0, 1, ..) on."""
    return F.substr(column, F.lit(first) * TURN + 1, F.lit(turns) * TURN)


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, seq: the ids of a conversation's turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = half_digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    size = F.unhex(F.lpad(F.hex(F.length(text)), 8, "0"))
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.concat(named, size).alias("id")).where("conv_id is not null")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), "id")))
    joined = F.unhex(F.array_join(F.transform(ordered, lambda x: F.hex(x["id"])), ""))
    return rows.groupBy("conv_id").agg(joined.alias("seq"))


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id, seq, key: the first turns from the conversation of the hundred, the rest its own; a digest of both."""
    shared = F.crc32(F.col("conv_id").cast("string")) % SHARED
    heads = own.select(F.col("conv_id").alias("base"), piece(F.col("seq"), 0, SHARED).alias("opening"))
    both = own.withColumns({"base": F.expr("conv_id - conv_id % 100"), "shared": shared.cast("int")}).join(heads, "base", "left")
    seq = F.concat(F.coalesce(piece(F.col("opening"), 0, F.col("shared")), F.lit(b"")), F.expr(f"substr(seq, shared * {TURN} + 1)"))
    return both.select("conv_id", seq.alias("seq")).withColumn("key", half_digest(F.col("seq")))


def digests_of_ids(members: DataFrame) -> DataFrame:
    """key, ends: the SHA-256 of the ascending, comma-joined conv_ids of every key."""
    parts = partitions(members.sparkSession)

    def pack(batches):
        key, ids = None, []

        def row():
            return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "at": pa.array([ids[0]], pa.int64()), "ids": [",".join(map(str, ids))]})

        for batch in batches:
            for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or len(ids) == PACK):
                    yield row()
                    ids = []
                key = k
                ids.append(conv)
        if ids:
            yield row()

    def digest(batches):
        key, state = None, None

        def row():
            return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends": pa.array([state.digest()], pa.binary())})

        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    yield row()
                key, state = k, hashlib.sha256(ids.encode())
        if state:
            yield row()

    ordered = members.select("key", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    packed = map_arrow(ordered, pack, "key binary, at bigint, ids string")
    return map_arrow(packed.repartition(parts, "key").sortWithinPartitions("key", "at"), digest, "key binary, ends binary")


def common_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that both strings begin with, at least ``known``."""
    most = min(len(a), len(b)) // TURN
    step, at = 1, known
    while at < most:  # growing steps, then halved ones
        step = min(step, most - at)
        if a[at * TURN : (at + step) * TURN] == b[at * TURN : (at + step) * TURN]:
            at += step
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
    return at


def sizes_of(seq: bytes) -> np.ndarray:
    """Code points of every turn's text."""
    return np.frombuffer(seq, np.uint8).reshape(-1, TURN)[:, 16:].copy().view(">u4").ravel().astype(np.int64)


class Node:
    __slots__ = ("depth", "first", "n", "ends", "leaves", "saved", "size", "closed")

    def __init__(self, depth: int, size: int):
        self.depth, self.size = depth, size
        self.first, self.n, self.ends, self.leaves, self.saved = None, 0, None, 0, 0
        self.closed: list[Node] = []

    def row(self, parent: int | None) -> tuple:
        return self.first, self.depth, parent, self.n, self.closed if isinstance(self.closed, int) else len(self.closed), self.leaves, self.saved, self.ends


class Sweep:
    """Nodes of one container after the other, from its sorted strings.

    A node is given out when its parent closes, since only then the parent's least member is known; so the
    nodes that wait are as many as a container's strings at most.
    """

    def __init__(self):
        self.out: list[tuple] = []
        self.box, self.up, self.above = None, None, None
        self.stack: list[Node] = []
        self.last = b""

    def close(self) -> None:
        node = self.stack.pop()
        for child in node.closed:
            self.out.append((*child.row(node.first), None))
        node.closed = len(node.closed)  # only the number is needed from here on
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.size
        if not self.stack:
            self.out.append((*node.row(self.up), self.above))
            return
        parent = self.stack[-1]
        parent.first = node.first if parent.first is None else min(parent.first, node.first)
        parent.n += node.n
        parent.leaves += node.leaves
        parent.saved += node.saved
        parent.closed.append(node)

    def end_box(self) -> None:
        while self.stack:
            self.close()

    def add(self, box: bytes, above: bytes, depth: int, up: int, seq: bytes, first: int, n: int, ends: bytes) -> None:
        if box != self.box:
            self.end_box()
            self.box, self.above, self.up, shared = box, above, up, depth - 1
        else:
            shared = common_turns(seq, self.last, depth)
            while self.stack[-1].depth > shared:
                self.close()
        sizes = sizes_of(seq[shared * TURN :]).tolist()
        self.stack += [Node(shared + 1 + i, size) for i, size in enumerate(sizes)]
        top = self.stack[-1]
        top.first, top.n, top.ends = (first if top.first is None else min(top.first, first)), top.n + n, ends
        self.last = seq


def swept(strings: DataFrame) -> DataFrame:
    """Every node of the containers; ``above``: for a container's top node the head that it hangs under."""

    def sweep(batches):
        state = Sweep()
        schema = pa.schema([(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends", pa.binary()), ("above", pa.binary())])

        def rows():
            columns = list(zip(*state.out)) or [()] * len(schema)
            state.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                state.add(*values)
                if len(state.out) > 20_000:
                    yield rows()
        state.end_box()
        yield rows()

    columns = ("box", "above", "depth", "up", "seq", "first", "n", "ends")
    dealt = strings.select(*columns).repartition(partitions(strings.sparkSession), "box").sortWithinPartitions("box", "seq")
    return map_arrow(dealt, sweep, f"{NODE}, above binary")


def new_heads(boxes: DataFrame) -> DataFrame:
    """The containers to burst, with the depth that their strings share and, from the container's top down to
    there, the code points of each turn and all below it."""

    def share(batches):
        for batch in batches:
            depths, bounds, sums = [], [0], []
            for depth, low, high in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("depth", "low", "high"))):
                common = common_turns(low, high)
                sizes = np.append(0, sizes_of(low[: common * TURN]))[depth:]
                depths.append(common)
                sums.append(np.cumsum(sizes[::-1])[::-1])
                bounds.append(bounds[-1] + len(sizes))
            chars = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(sums) if sums else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in ("box", "above", "depth", "up", "first", "n")), pa.array(depths, pa.int32()), chars],
                ["box", "above", "depth", "up", "first", "n", "common", "chars"],
            )

    return map_arrow(boxes, share, "box binary, above binary, depth int, up bigint, first bigint, n bigint, common int, chars array<bigint>")


def burst(strings: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """The strings in their last containers, and the heads of every round of bursts."""
    active = strings
    settled, rounds = [], []
    while True:
        boxes = active.groupBy("box", "above", "depth", "up").agg(
            F.count("*").alias("strings"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.min("first").alias("first"), F.sum("n").alias("n"))
        heads = materialise(new_heads(boxes.where(F.col("strings") > (limit if rounds else 0))), "trie-heads")
        if heads.isEmpty():
            settled.append(active)
            break
        moved = active.join(heads.select("box", "common", F.col("first").alias("of_head")), "box", "left")
        settled.append(moved.where("common is null").select(active.columns))
        whole = F.octet_length("seq") == F.col("common") * TURN
        ending = moved.where("common is not null").where(whole).select("box", F.col("ends").alias("ends"))
        rounds.append(heads.join(ending, "box", "left"))
        below = moved.where("common is not null").where(~whole).select(
            half_digest(piece(F.col("seq"), 0, F.col("common") + 1)).alias("box"), F.col("box").alias("above"), (F.col("common") + 1).alias("depth"),
            F.col("of_head").alias("up"), "seq", "first", "n", "ends")
        active = materialise(below, "trie-strings")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out, rounds


def trie(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends (SHA-256, null where no
    conversation ends) of every node.

    ``turns`` has conv_id, turn, role, text.
    """
    members = materialise(rebuilt(materialise(sequences(turns), "trie-own")), "trie-rebuilt")
    distinct = members.groupBy("key", "seq").agg(F.min("conv_id").alias("first"), F.count("*").alias("n"))
    strings = distinct.join(digests_of_ids(members).hint("shuffle_hash"), "key").select(
        F.lit(b"").alias("box"), F.lit(b"").alias("above"), F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("up"), "seq", "first", "n", "ends")
    strings = materialise(strings, "trie-distinct")
    last, rounds = burst(strings, limit)
    nodes = materialise(swept(last), "trie-nodes")
    tops = nodes.where("above is not null").groupBy("above").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    out, higher = nodes.drop("above"), None
    for heads in reversed(rounds):
        sums = tops if higher is None else tops.unionByName(higher).groupBy("above").agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved")))
        known = heads.join(sums.withColumnRenamed("above", "box"), "box", "left").withColumns({
            "children": F.coalesce("children", F.lit(0)), "leaves": F.coalesce("leaves", F.lit(1)), "saved": F.coalesce("saved", F.lit(0))})
        known = materialise(known, "trie-folded")
        higher = known.select("above", F.lit(1).cast("bigint").alias("children"), "leaves", (F.col("saved") + (F.col("n") - 1) * F.col("chars")[0]).alias("saved"))
        chain = known.select("*", F.posexplode("chars").alias("at", "below"))
        lowest = F.col("at") == F.size("chars") - 1
        out = out.unionByName(chain.select(
            F.col("first").alias("conv_id"), (F.col("depth") + F.col("at")).cast("bigint").alias("depth"), F.when(F.col("at") == 0, F.col("up")).otherwise(F.col("first")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.when(lowest, F.col("children")).otherwise(1).cast("bigint").alias("n_children"), F.col("leaves").alias("n_leaves"),
            (F.col("saved") + (F.col("n") - 1) * F.col("below")).alias("saved_tokens"), F.when(lowest, F.col("ends")).alias("ends")))
    return out
