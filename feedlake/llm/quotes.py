"""Reply-ordered conversations without quotes, by linking quoted passages to where they were written.

Only DataFrame functions are used.  Marks (``>``) before a line give its quote level; neighbouring lines
of one level are a passage, so other line breaks in a quote don't matter.  Passages are normalised
(lower case, white space to one blank) and hashed.  A quoted passage belongs to the earliest message of
its conversation that has it unquoted, if that is earlier than the quoting one.  A quote of no complete
passage is looked up by its lines and by its sentences of at least ``PIECE`` characters: each belongs to the
earliest message that has it unquoted as a line or sentence, and the quote to the earlier message that
covers most of it, half of its characters at least (the earliest of equals).  A message replies to the
original of its least level, the latest of those.  Roots and depths come from doubling pointers, in as
many rounds as the logarithm of the longest chain of replies.

A conversation is ordered by the turn that began the thread, then depth, then turn, role and text, so what
is answered comes before the answer; messages without a reply begin threads.  Places are numbered by one
sort over ranges and the sizes of the ranges, so a conversation of any length is spread over tasks.

The body is what stands unquoted, without a line that introduces a quote (``... wrote:`` before a quoted
line), trimmed.  A null text is empty; a null turn comes before all others; null conv_ids are one
conversation; a turn that several rows have takes the latest original that any of them quotes; repeated
rows are places of their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.shared import materialise, partitions

MARKS = r"^(?:[ \t]*>)+"
INTRODUCES = r"(?i)(wrote|writes|schrieb|a écrit|escribió) ?:[ \t]*$"
PIECE = 10
SENTENCES = r"(?<=[.!?…]) |(?<=[。！？]) ?"
NO_TURN = -(2**62)


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with body, quotes (level, key of the passage, its size and pieces) and keys of their own passages and pieces."""
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    levelled = F.transform(
        lines, lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS + r"[ \t]?", "").alias("line")
        )
    )
    at = lambda i: F.get(F.col("lines"), i)
    blank = lambda x: F.trim(F.regexp_replace(x["line"], r"[\x09-\x0D\x20]+", " ")) == ""
    introduces = lambda x, i: (x["level"] == 0) & x["line"].rlike(INTRODUCES) & F.coalesce(at(i + 1)["level"] > 0, F.lit(False))
    starts = F.filter(
        F.transform("lines", lambda x, i: F.when((i == 0) | (x["level"] != at(i - 1)["level"]) | blank(x) | blank(at(i - 1)) | introduces(x, i), i)), lambda i: i.isNotNull()
    )
    end = lambda k: F.coalesce(F.get(F.col("starts"), k + 1), F.size("lines"))
    within = lambda s, k: F.transform(F.slice("lines", s + 1, end(k) - s), lambda x: x["line"])
    normal = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[\x09-\x0D\x20]+", " "))
    passages = F.transform(
        "starts", lambda s, k: F.struct(at(s)["level"].alias("level"), introduces(at(s), s).alias("introduces"), normal(F.array_join(within(s, k), " ")).alias("text"), F.transform(within(s, k), normal).alias("lines"))
    )
    long = lambda parts: F.filter(parts, lambda x: F.length(x) >= PIECE)
    sentences = lambda p: F.split(p["text"], SENTENCES)
    pieces = lambda parts, kind: F.transform(long(parts), lambda x: F.struct(F.lit(kind).alias("kind"), F.xxhash64(x).alias("piece"), F.length(x).alias("covers")))
    kept = F.filter("lines", lambda x, i: (x["level"] == 0) & ~introduces(x, i))
    key = lambda p: F.unhex(F.sha2(p["text"], 256))
    body = F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "")
    # written between the steps: a column used for every line must be a value, not an expression run anew
    lined = materialise(messages.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.xxhash64("text", "role").alias("tie"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.coalesce(F.col("turn").cast("bigint"), F.lit(NO_TURN)).alias("at"), levelled.alias("lines"),
    ), "quotes-lines")
    started = materialise(lined.withColumn("starts", starts), "quotes-starts")
    return materialise(started.withColumn("passages", passages).select(
        "conv_id", "turn", "role", "conv", "at", body.alias("body"), "tie",
        F.transform(F.filter("passages", lambda p: (p["level"] > 0) & (p["text"] != "")), lambda p: F.struct(
            p["level"].alias("level"), key(p).alias("key"), F.length(p["text"]).alias("size"), F.concat(pieces(p["lines"], "line"), pieces(sentences(p), "sentence")).alias("pieces")
        )).alias("quotes"),
        F.transform(F.filter("passages", lambda p: (p["level"] == 0) & (p["text"] != "") & ~p["introduces"]), key).alias("own"),
        F.flatten(F.transform(
            F.filter("passages", lambda p: (p["level"] == 0) & ~p["introduces"]), lambda p: F.array_union(F.transform(long(p["lines"]), lambda x: F.xxhash64(x)), F.transform(long(sentences(p)), lambda x: F.xxhash64(x)))
        )).alias("own_pieces"),
    ), "quotes-parsed")


def partial(messages: DataFrame, quoted: DataFrame) -> DataFrame:
    """conv, at, level, original of quotes of which lines or sentences cover most."""
    parts = materialise(quoted.dropDuplicates(["conv", "at", "level", "key"]).select("conv", "at", "level", "key", "size", F.inline("pieces")), "quotes-pieces")
    own = messages.select("conv", "at", F.explode("own_pieces").alias("piece")).join(parts.select("conv", "piece").distinct(), ["conv", "piece"], "left_semi")
    own = own.groupBy("conv", "piece").agg(F.min("at").alias("original"))
    quote = ["conv", "at", "level", "key"]
    covered = parts.join(own, ["conv", "piece"]).where(F.col("original") < F.col("at")).groupBy(*quote, "size", "kind", "original").agg(F.sum("covers").alias("covered"))
    best = F.max_by("original", F.struct("covered", -F.col("original"))).alias("original")
    return covered.where(2 * F.col("covered") >= F.col("size")).groupBy(*quote).agg(best).select("conv", "at", "level", "original")


def replies(messages: DataFrame) -> DataFrame:
    """conv, at, reply_to: the earlier turn that each quoting turn answers."""
    quoted = messages.where(F.size("quotes") > 0).select("conv", "at", F.explode("quotes").alias("quote")).select("conv", "at", "quote.*")
    quoted = materialise(quoted, "quotes-quoted")
    if quoted.isEmpty():
        return quoted.select("conv", "at", F.col("at").alias("reply_to"))
    wanted = quoted.select("conv", "key").distinct()
    own = messages.select("conv", "at", F.explode("own").alias("key")).groupBy("conv", "key").agg(F.min("at").alias("original"))
    own = materialise(own.join(wanted, ["conv", "key"], "left_semi"), "quotes-own")
    met = quoted.join(own, ["conv", "key"]).where(F.col("original") < F.col("at")).select("conv", "at", "level", "key", "original")
    met = materialise(met, "quotes-met")
    rest = materialise(quoted.join(met, ["conv", "at", "level", "key"], "left_anti"), "quotes-rest")
    met = met.drop("key")
    if not rest.isEmpty():
        met = met.unionByName(partial(messages, rest))
    nearest = F.max_by("original", F.struct(-F.col("level"), F.col("original")))
    return materialise(met.groupBy("conv", "at").agg(nearest.alias("reply_to")), "quotes-replies")


def threads(links: DataFrame) -> DataFrame:
    """conv, at, reply_to, root, depth of every turn that replies."""
    nodes = links.select("conv", "at", "reply_to", F.col("reply_to").alias("root"), F.lit(1).cast("bigint").alias("depth"))
    while True:
        upper = nodes.select("conv", F.col("at").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        if nodes.join(upper, ["conv", "root"], "left_semi").isEmpty():
            return nodes
        nodes = materialise(
            nodes.join(upper, ["conv", "root"], "left").select(
                "conv", "at", "reply_to", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
            ), "quotes-nodes",
        )


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Each row's place in its group from 0 on, by ``order``, without a task that holds a whole group."""
    n = partitions(rows.sparkSession)
    ranged = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    ranged = materialise(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")), "quotes-ranged")
    ranged = ranged.withColumn("nth", F.col("nth").bitwiseAND(F.lit((1 << 33) - 1)))
    # one row for each range: no more than there are partitions
    before, offsets = 0, []
    for r in ranged.groupBy("part").count().orderBy("part").collect():
        offsets.append((r.part, before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(offsets, "part int, before bigint")
    ranged = ranged.join(F.broadcast(offsets), "part").withColumn("nth", F.col("before") + F.col("nth")).drop("part", "before")
    first = materialise(ranged.groupBy(group).agg(F.min("nth").alias("first")), "quotes-first")
    return ranged.join(first, group).withColumn("position", F.col("nth") - F.col("first")).drop("nth", "first")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, body, reply_to, thread_root, depth, quote_levels of every message."""
    found = parsed(messages)
    nodes = threads(replies(found))
    shown = lambda c: F.when(F.col(c) != NO_TURN, F.col(c))
    placed = found.join(nodes, ["conv", "at"], "left").select(
        "conv_id", "conv", "turn", "role", "body", "tie", "at", "reply_to", F.coalesce("root", "at").alias("root"), F.coalesce("depth", F.lit(0).cast("bigint")).alias("depth"),
        F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).alias("quote_levels"),
    )
    return numbered(placed, "conv", ["root", "depth", "at", "role", "body", "tie"]).select(
        "conv_id", "position", "turn", "role", "body", shown("reply_to").alias("reply_to"), shown("root").alias("thread_root"), "depth", "quote_levels"
    )
