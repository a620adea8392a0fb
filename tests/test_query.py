"""Filters and pages."""

import re

import pytest
from pyspark.sql import functions as F

from feedlake.operators import query as Q


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (f"title {i}", f"http://{'ab'[i % 2]}.org/{i:03d}", "Some 50% text_" if i % 3 else "OTHER", "ann" if i % 4 else "Ann", i // 3)
        for i in range(60)
    ]
    df = spark.createDataFrame(rows, "title string, link string, description string, author string, t int")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t") * 60)
    return df.withColumn("pub_ts", ts).withColumn("pub_date", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).drop("t").cache()


def links(df):
    return [r.link for r in df.collect()]


def ordered(df):
    return [r.link for r in sorted(df.collect(), key=lambda r: (-r.pub_ts.timestamp(), r.link))]


def test_source_is_an_exclusive_prefix_range(items):
    assert len(links(Q.filter_source(items, "http://a.org/"))) == 30
    assert links(Q.filter_source(items, "http://a.org/000")) == []
    assert links(Q.filter_source(items, "a.org")) == []


def test_author_is_case_sensitive(items):
    assert len(links(Q.filter_author(items, "Ann"))) == 15


def test_keyword_is_literal_and_ignores_case(items):
    assert len(links(Q.filter_keyword(items, "other"))) == 20
    assert len(links(Q.filter_keyword(items, "50% TEXT_"))) == 40
    assert links(Q.filter_keyword(items, "50_ text")) == []
    assert len(links(Q.filter_keyword(items, "TITLE 5"))) == 11


def test_dates_are_inclusive_and_compare_instants(items):
    at = "2023-11-14T22:14:20Z"
    assert len(links(Q.filter_dates(items, at, at))) == 3
    assert len(links(Q.filter_dates(items, "2023-11-15T00:14:20+02:00", at))) == 3
    with pytest.raises(ValueError):
        Q.filter_dates(items, "2023-11-14")


@pytest.mark.parametrize("request_, size, start", [
    (Q.PageRequest(), 100, 0), (Q.PageRequest(limit=-5), 100, 0), (Q.PageRequest(limit=5000), 1000, 0),
    (Q.PageRequest(offset=-3), 100, 0), (Q.PageRequest(offset=3, cursor="offset:7"), 100, 7),
    (Q.PageRequest(offset=3, cursor="offset:x"), 100, 3), (Q.PageRequest(offset=3, cursor="offset:"), 100, 3),
    (Q.PageRequest(offset=3, cursor="page:9"), 100, 3), (Q.PageRequest(cursor="offset:-4"), 100, 0),
    (Q.PageRequest(offset=3, cursor="offset:1_0"), 100, 3), (Q.PageRequest(offset=3, cursor="offset: 7"), 100, 3),
    (Q.PageRequest(offset=3, cursor="offset:\u0667"), 100, 3), (Q.PageRequest(offset=3, cursor="offset:+8"), 100, 8),
])
def test_page_parameters(request_, size, start):
    assert (request_.size, request_.start) == (size, start)


def test_pages_laid_end_to_end_are_the_sorted_table(items):
    whole, cursor = [], ""
    while True:
        page = Q.items_page(items, request=Q.PageRequest(limit=13, cursor=cursor)).first()
        assert page.total_count == 60
        whole += [i.link for i in page["items"]]
        if not page.has_more:
            assert page.next_cursor == ""
            break
        cursor = page.next_cursor
    assert whole == ordered(items)


def test_keyset_pages_laid_end_to_end_are_the_sorted_table(items):
    rows = Q.page_items(items, Q.PageRequest(limit=7)).collect()
    whole = [r.link for r in rows]
    while rows:
        rows = Q.keyset_page(items, rows[-1].pub_date, rows[-1].link, limit=7).collect()
        whole += [r.link for r in rows]
    assert whole == ordered(items)


def test_keyword_after_the_page_leaves_total_and_overlaps(items):
    wanted = Q.ItemFilter(keyword="other")
    page = Q.items_page(items, wanted, Q.PageRequest(limit=9, offset=5)).first()
    fetched = ordered(items)[5:14]
    kept = [link for link in fetched if int(link[-3:]) % 3 == 0]
    assert [i.link for i in page["items"]] == kept
    assert (page.total_count, page.has_more, page.next_cursor) == (60, True, f"offset:{5 + len(kept)}")


def test_keyword_before_the_page_counts_matches(items):
    page = Q.items_page(items, Q.ItemFilter(keyword="other"), Q.PageRequest(limit=50), "pre_page").first()
    assert (len(page["items"]), page.total_count, page.has_more, page.next_cursor) == (20, 20, False, "")


def test_empty_store_gives_an_empty_page(items):
    page = Q.items_page(items.limit(0), request=Q.PageRequest(limit=10)).first()
    assert (list(page["items"]), page.total_count, page.has_more, page.next_cursor) == ([], 0, False, "")


def test_paging_is_a_top_k_not_a_sort(items):
    plan = Q.page_items(items, Q.PageRequest(limit=5, offset=3))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.fixture(scope="module")
def lenient(spark, items):
    number = F.substring_index("link", "/", -1).cast("int")
    none = F.lit(None).cast("timestamp")
    return items.withColumn("pub_ts", F.when(number % 5 == 0, none).otherwise(F.col("pub_ts"))).cache()


def test_undated_items_come_last_in_the_page_array(lenient):
    found = Q.items_page(lenient, Q.ItemFilter(), Q.PageRequest(limit=60)).first()["items"]
    dated = {r.link: r.pub_ts for r in lenient.collect()}
    want = sorted(dated, key=lambda k: (dated[k] is None, -dated[k].timestamp() if dated[k] else 0, k))
    assert [r.link for r in found] == want


def test_a_keyset_walk_reaches_every_row(lenient):
    seen, after = [], None
    page = Q.page_items(lenient, Q.PageRequest(limit=7)).collect()
    while page:
        seen += [r.link for r in page]
        last = page[-1]
        after = last.pub_ts.strftime("%Y-%m-%dT%H:%M:%SZ") if last.pub_ts else None
        page = Q.keyset_page(lenient, after, last.link, 7).collect()
    assert len(seen) == len(set(seen)) == 60


@pytest.mark.parametrize("parts", [False, True])
def test_deep_pages_equal_the_plain_ones(spark, parts):
    """A third at one instant, a third undated, links with long common beginnings and equal ones."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.timestamp_seconds(F.lit(1_700_000_000))).when(F.col("id") % 3 == 1, F.timestamp_seconds(1_690_000_000 + F.col("id") * 5000)).alias("pub_ts"),
        F.concat(F.lit("https://a.example.org/"), F.when(F.col("id") % 7 == 0, "same").otherwise(F.conv(F.xxhash64("id").cast("string"), 10, 36))).alias("link"), "id",
    )
    rows = rows.withColumn("pub_part", F.to_date(F.date_trunc("month", "pub_ts"))) if parts else rows
    rows = rows.cache()
    for start in (0, 3, 700, 999, 1000, 1500, 1999, 2000, 2003, 2500, 2990, 2999, 3000, 9999):
        request = Q.PageRequest(limit=40, offset=start)
        got = [(r.pub_ts, r.link) for r in Q.seek_page(rows, request, slice_rows=50).collect()]
        assert got == [(r.pub_ts, r.link) for r in Q.page_items(rows, request).collect()], start


def test_a_deep_page_skips_few_rows(spark, monkeypatch):
    monkeypatch.setattr(Q, "DEEP_START", 500)
    rows = spark.range(20_000).select(F.timestamp_seconds(1_600_000_000 + F.col("id") * 60).alias("pub_ts"), F.concat(F.lit("l"), "id").alias("link"), "id")
    page = Q.page_items(rows, Q.PageRequest(limit=10, offset=15_000))
    assert [r.id for r in page.collect()] == list(range(4_999, 4_989, -1))
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert all(int(n) <= 510 for n in re.findall(r"(?:Offset|Limit) (\d+)", plan)) and "orderBy" not in plan
    assert Q.seek_page(rows.limit(0), Q.PageRequest(offset=7)).collect() == []
