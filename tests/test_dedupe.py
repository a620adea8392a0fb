"""Duplicates and upserts."""

import hashlib

import pytest

from feedlake.operators import dedupe

SCHEMA = "ingest_seq long, link string, title string, description string, author string, pub_date string, content_hash string"


def item(seq, link, title, description="d", author="a"):
    digest = hashlib.md5((title + description + author).encode()).hexdigest()
    return (seq, link, title, description, author, "2024-07-01T00:00:00Z", digest)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute_drop_known(incoming, stored):
    """Row-at-a-time restatement of the rule."""
    by_link = {s[1]: s for s in stored}
    witness = {}
    for row in incoming:
        if row[1] in by_link:
            witness[row[6]] = by_link[row[1]]
    out = []
    for row in incoming:
        w = witness.get(row[6])
        if w and (row[1] == w[1] or (row[2], row[4]) == (w[2], w[4]) or row[6] == w[6]):
            continue
        out.append(row[0])
    return out


def test_hash_twins_share_the_witness_of_the_last_one(spark):
    stored = [item(1, "L1", "old one"), item(2, "L2", "T"), item(3, "L3", "other", author="b")]
    incoming = [
        item(10, "L1", "T"),           # stored under L1 with another text; twin of 11 and 12
        item(11, "L2", "T"),           # stored as it is
        item(12, "N1", "T"),           # new link, same text: a duplicate by hash of L2's row
        item(13, "L3", "fresh text"),  # own link stored: dropped by link
        item(14, "N2", "brand new"),
        item(15, "N3", "ab", "c"), item(16, "N4", "a", "bc"),  # equal hash without a separator
    ]
    kept = [r.ingest_seq for r in dedupe.drop_known(frame(spark, incoming), frame(spark, stored)).collect()]
    assert sorted(kept) == sorted(brute_drop_known(incoming, stored)) == [14, 15, 16]


def test_a_survivor_may_overwrite_a_stored_link(spark):
    # the witness of the shared hash is L2's edited row, so L1's incoming version survives and replaces L1
    stored = [item(1, "L1", "first text"), item(2, "L2", "edited", author="z")]
    incoming = [item(10, "L1", "T"), item(11, "L2", "T")]
    assert brute_drop_known(incoming, stored) == [10]
    table = dedupe.upsert_items(frame(spark, stored), frame(spark, incoming)).collect()
    assert {(r.link, r.title) for r in table} == {("L1", "T"), ("L2", "edited")}


def test_random_batches_match_the_restated_rule(spark):
    import random

    rng = random.Random(5)
    def rows(first, n, links):
        return [item(first + i, f"L{rng.randrange(links)}", f"t{rng.randrange(4)}", f"d{rng.randrange(2)}", f"a{rng.randrange(2)}") for i in range(n)]
    for _ in range(3):
        stored = list({r[1]: r for r in rows(0, 40, 30)}.values())
        incoming = rows(100, 80, 60)
        got = dedupe.drop_known(frame(spark, incoming), frame(spark, stored)).collect()
        assert sorted(r.ingest_seq for r in got) == sorted(brute_drop_known(incoming, stored))


def test_last_of_a_link_in_a_batch_wins_and_upsert_is_idempotent(spark):
    stored = frame(spark, [item(1, "L1", "x")])
    incoming = frame(spark, [item(10, "N1", "v1"), item(11, "N1", "v2"), item(12, "L1", "y")])
    once = dedupe.upsert_items(stored, incoming)
    assert {(r.link, r.title) for r in once.collect()} == {("L1", "x"), ("N1", "v2")}
    twice = dedupe.upsert_items(once, incoming)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    counts = dedupe.upsert_counts(stored, incoming).first()
    assert (counts.offered, counts.put, counts.replaced_in_batch) == (3, 2, 1)
    all_in = dedupe.upsert_items(stored, incoming, dedupe=False)
    assert {(r.link, r.title) for r in all_in.collect()} == {("L1", "y"), ("N1", "v2")}


def test_pairs_stay_linear_in_a_hot_group(spark):
    rows = [item(i, f"L{i}", "same", f"text {i}") for i in range(300)] + [item(900, "L0", "solo", "text", "x")]
    pairs = dedupe.duplicate_pairs(frame(spark, rows)).collect()
    assert len(pairs) == 300
    assert {p.first_seq for p in pairs} == {0}
    assert {p.reasons for p in pairs} == {"title_author", "link"}


def test_all_reasons_are_named(spark):
    rows = [item(1, "L", "t"), item(2, "L", "t")]
    assert dedupe.duplicate_pairs(frame(spark, rows)).first().reasons == "link,title_author,content_hash"


def test_no_nested_loop_and_ranks_are_cut_before_the_shuffle(spark):
    rows = frame(spark, [item(1, "L", "t"), item(2, "L", "t")])
    plan = dedupe.duplicate_pairs(rows)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "WindowGroupLimit" in dedupe.last_per_link(rows, "ingest_seq")._jdf.queryExecution().toString()


@pytest.mark.parametrize("count, configured, size", [
    (5, 0, 50), (25, 0, 200), (50, 0, 200), (150, 0, 500), (500, 0, 1000), (1500, 0, 2000), (2000, 0, 2000), (100, 300, 300),
])
def test_batch_sizes(spark, count, configured, size):
    from pyspark.sql import functions as F

    assert spark.range(1).select(dedupe.batch_size(F.lit(count), configured)).first()[0] == size


def test_configured_batch_size():
    assert [dedupe.configured_batch_size(*s) for s in ((), (0,), (250,), (300, 400, 500))] == [0, 0, 250, 300]
