"""Normalisation and validation against hand-worked values."""

import hashlib

import pytest
from pyspark.sql import functions as F

from feedlake import constants as C
from feedlake.operators.items import accept_entries, normalize_items, quarantined, validate_items

RAW = "title string, link string, description string, author string, published string"


def normal(spark, rows, policy="strict"):
    return normalize_items(spark.createDataFrame(rows, RAW), policy).drop("pub_ts").collect()


def date_of(spark, published, policy="strict"):
    row = normal(spark, [("t", "http://x.org/", "d", None, published)], policy)[0]
    return row.pub_date


def test_text_is_trimmed_and_author_defaults(spark):
    row = normal(spark, [("  A ", "\thttp://x.org/a\n", "　d \u0085", None, "")])[0]
    assert (row.title, row.link, row.description, row.author) == ("A", "http://x.org/a", "d", "Unknown")
    row = normal(spark, [("A", "/x", "d", "", "")])[0]
    assert row.author == ""
    assert row.content_hash == hashlib.md5(b"Ad").hexdigest()


@pytest.mark.parametrize("text, expected", [
    ("Mon, 01 Jul 2024 10:20:30 +0000", "2024-07-01T10:20:30Z"),
    ("Mon, 01 Jul 2024 10:20:30 -0000", "2024-07-01T10:20:30Z"),
    ("Mon, 01 Jul 2024 10:20:30 +0530", "2024-07-01T10:20:30+05:30"),
    ("Fri, 01 Jul 2024 10:20:30 -0330", "2024-07-01T10:20:30-03:30"),
    ("mon, 01 JUL 2024 9:20:30.75 +0200", "2024-07-01T09:20:30+02:00"),
    ("Mon, 31 Feb 2024 10:20:30 +0000", C.ZERO_TIME_TEXT),
    ("Mon, 01 Jul 2024 10:20:30 GMT", C.ZERO_TIME_TEXT),
    ("Mon, 1 Jul 2024 10:20:30 +0000", C.ZERO_TIME_TEXT),
    ("2024-07-01T10:20:30Z", C.ZERO_TIME_TEXT),
    ("Xyz, 01 Jul 2024 10:20:30 +0000", C.ZERO_TIME_TEXT),
    (None, C.ZERO_TIME_TEXT),
    ("", C.ZERO_TIME_TEXT),
])
def test_strict_dates(spark, text, expected):
    assert date_of(spark, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("Mon, 01 Jul 2024 10:20:30 +0530", "2024-07-01T04:50:30Z"),
    ("Mon, 01 Jul 2024 10:20:30 GMT", "2024-07-01T10:20:30Z"),
    ("Mon, 01 Jul 2024 10:20:30 GMT+2", "2024-07-01T08:20:30Z"),
    ("Mon, 01 Jul 2024 10:20:30 CEST", "2024-07-01T10:20:30Z"),
    ("2024-07-01T10:20:30+02:00", "2024-07-01T08:20:30Z"),
    ("2024-07-01T10:20:30.123Z", "2024-07-01T10:20:30Z"),
    ("2024-07-01 10:20:30", "2024-07-01T10:20:30Z"),
    ("2024-13-01 10:20:30", ""),
    ("yesterday", ""),
])
def test_lenient_dates(spark, text, expected):
    assert date_of(spark, text, "lenient") == expected


def test_unknown_policy_is_an_error(spark):
    with pytest.raises(ValueError):
        normalize_items(spark.createDataFrame([], RAW), "loose")


def test_instant_keeps_the_offset_out_of_the_text(spark):
    rows = spark.createDataFrame([("t", "/a", "d", "a", "Mon, 01 Jul 2024 00:00:00 +0200")], RAW)
    row = normalize_items(rows).select("pub_date", F.unix_seconds("pub_ts").alias("s")).first()
    assert (row.pub_date, row.s) == ("2024-07-01T00:00:00+02:00", 1719784800)


def check(spark, **changes):
    item = {"title": "t", "link": "http://x.org/a", "description": "d", "author": "a", "pub_date": "2024-07-01T00:00:00Z"}
    df = spark.createDataFrame([{**item, **changes}], "title string, link string, description string, author string, pub_date string")
    return list(validate_items(df).first().errors)


def test_each_rule_and_the_byte_limits(spark):
    assert check(spark) == []
    assert check(spark, title="  ") == [C.ERR_TITLE_EMPTY]
    assert check(spark, title="é" * 250) == []
    assert check(spark, title="é" * 251) == [C.ERR_TITLE_LONG]
    assert check(spark, description="x" * 2000) == []
    assert check(spark, description="x" * 2001) == [C.ERR_DESCRIPTION_LONG]
    assert check(spark, author="ü" * 51) == [C.ERR_AUTHOR_LONG]
    assert check(spark, pub_date="") == []
    assert check(spark, pub_date="2024-07-01") == [C.ERR_PUB_DATE]
    assert check(spark, pub_date="2024-02-30T00:00:00Z") == [C.ERR_PUB_DATE]
    assert check(spark, title="", link=" ", description="x" * 2001, author="y" * 101, pub_date="z") == [
        C.ERR_TITLE_EMPTY, C.ERR_LINK_EMPTY, C.ERR_DESCRIPTION_LONG, C.ERR_AUTHOR_LONG, C.ERR_PUB_DATE,
    ]


@pytest.mark.parametrize("link, ok", [
    ("http://x.org/a?b=c#d", True), ("/rooted/path", True), ("mailto:someone", True), ("*", True),
    ("x.org/a", False), ("#top", False), ("http://x.org/%zz", False), ("http://x.org/a b", True),
    ("http://x y.org/", False), ("http://x.org:80a/", False), ("http://x.org:/", True), ("http://[::1]:8080/a", True),
    ("http://[::1/a", False), ("http://x.org/" + "%41b" * 60000, True), ("http://x.org/" + "ab" * 90000 + "%4", False), ("http://u:p@x.org/", True), (":x", False), ("http://x.org/\x01", False), ("1http://x", False),
])
def test_links(spark, link, ok):
    assert (check(spark, link=link) == []) is ok


def test_accepted_and_quarantined_split_everything(spark):
    raw = spark.createDataFrame([
        ("ok", "http://x.org/1", "d", "a", ""), ("", "http://x.org/2", "d", "a", ""), ("t", "nowhere", "d", "a", ""),
    ], RAW)
    good = accept_entries(raw)
    bad = quarantined(normalize_items(raw))
    assert [r.link for r in good.select("link").collect()] == ["http://x.org/1"]
    assert {r.error for r in bad.select("error").collect()} == {
        C.ERR_PREFIX + C.ERR_TITLE_EMPTY, C.ERR_PREFIX + C.ERR_LINK_INVALID,
    }
