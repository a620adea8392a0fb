"""URL screening and origins."""

import pytest

from feedlake import constants as C
from pyspark.sql import functions as F

from feedlake.operators.screening import OriginPolicy, origin_audit, origin_audit_by_rules, origin_rules, screen_urls

CASES = [
    # url, basic reason, strict reason, sanitised
    ("https://news.example.org/feed.xml", None, None, "https://news.example.org/feed.xml"),
    ("http://news.example.org/", None, None, "http://news.example.org/"),
    ("", C.URL_EMPTY, C.URL_EMPTY, None),
    ("ftp://files.example.org/a", C.URL_SCHEME, C.URL_SCHEME, None),
    ("http://localhost:8080/rss", C.URL_LOCALHOST, C.URL_PRIVATE, None),
    ("http://192.168.1.9/feed", None, C.URL_PRIVATE, "http://192.168.1.9/feed"),
    ("http://10.1.2.3:8080/", None, C.URL_PRIVATE, "http://10.1.2.3:8080/"),
    ("http://127.9.9.9/", None, C.URL_PRIVATE, "http://127.9.9.9/"),
    ("http://0.0.0.0/", None, C.URL_PRIVATE, "http://0.0.0.0/"),
    ("http://172.15.0.1/", None, None, "http://172.15.0.1/"),
    ("http://172.16.0.1/", None, C.URL_PRIVATE, "http://172.16.0.1/"),
    ("http://172.31.255.255/", None, C.URL_PRIVATE, "http://172.31.255.255/"),
    ("http://172.32.0.1/", None, None, "http://172.32.0.1/"),
    ("http://010.1.2.3/", None, None, "http://010.1.2.3/"),
    ("http://build.corp/rss", None, C.URL_PRIVATE, "http://build.corp/rss"),
    ("https://a.example.org/setup.EXE", None, C.URL_EXTENSION, "https://a.example.org/setup.EXE"),
    ("https://a.example.org/data.json", None, C.URL_EXTENSION, "https://a.example.org/data.json"),
    ("https://a.example.org/rss.php?id=1", None, C.URL_EXTENSION, "https://a.example.org/rss.php?id=1"),
    ("https://a.example.org/f?q=<script>", None, C.URL_MALICIOUS, "https://a.example.org/f?q=<script>"),
    ("https://a.example.org/f?q=%3CScRipt%3E", None, C.URL_MALICIOUS, "https://a.example.org/f?q=%3CScRipt%3E"),
    ("https://a.example.org/f?x=1&q=eval%281", None, C.URL_MALICIOUS, "https://a.example.org/f?x=1&q=eval%281"),
    ("https://a.example.org/f?q=%zz<script", None, None, "https://a.example.org/f?q=%zz<script"),
    ("https://a.example.org/f?q=<script;x", None, None, "https://a.example.org/f?q=<script;x"),
    ("https://a.example.org/f?cookie=1", None, None, "https://a.example.org/f?cookie=1"),
    ("https://a.example.org/" + "x" * 2100, None, C.URL_TOO_LONG, "https://a.example.org/" + "x" * 2100),
    ("https:///x", C.URL_HOST, C.URL_HOST, None),
    ("a.example.org/feed", C.URL_HOST, C.URL_HOST, None),
    ("a.example.org:80/feed", C.URL_SCHEME, C.URL_SCHEME, None),
    ("//a.example.org/feed", None, None, "https://a.example.org/feed"),
    ("http://[::1]:80/feed", None, None, "http://[::1]:80/feed"),
    ("HTTP://A.example.org/b#", None, None, "http://A.example.org/b"),
    ("http://a.example.org/b#c", None, None, "http://a.example.org/b#c"),
    ("http://a.example.org/a b(c)+d", None, None, "http://a.example.org/a%20b%28c%29+d"),
    ("http://a.example.org/café", None, None, "http://a.example.org/caf%C3%A9"),
    ("http://a.example.org/%zz", C.URL_UNPARSABLE, C.URL_UNPARSABLE, None),
    ("http://a b.example.org/", C.URL_UNPARSABLE, C.URL_UNPARSABLE, None),
    ("http://a.example.org:port/", C.URL_UNPARSABLE, C.URL_UNPARSABLE, None),
    ("http://a.example.org/\n", C.URL_UNPARSABLE, C.URL_UNPARSABLE, None),
    ("10.0.0.1:80/x", C.URL_UNPARSABLE, C.URL_UNPARSABLE, None),
    ("mailto:a@example.org", C.URL_SCHEME, C.URL_SCHEME, None),
    ("http:example.org", C.URL_HOST, C.URL_HOST, None),
    ("http://a@b@h.example.org/", None, None, "http://a@b@h.example.org/"),
    ("http://u%20v@h.example.org/", None, None, "http://u%20v@h.example.org/"),
    ("http://u v@h.example.org/", C.URL_UNPARSABLE, C.URL_UNPARSABLE, None),
    ("http://h%20.example.org/", C.URL_UNPARSABLE, C.URL_UNPARSABLE, None),
    ("http://[::1]x/", C.URL_UNPARSABLE, C.URL_UNPARSABLE, None),
    ("http://a.example.org/" + "%41/" * 50000, None, C.URL_TOO_LONG, "http://a.example.org/" + "%41/" * 50000),
    ("http://a.example.org/f?" + "a=b&" * 50000, None, C.URL_TOO_LONG, "http://a.example.org/f?" + "a=b&" * 50000),
    ("http://u:p@localhost.example.org/", C.URL_LOCALHOST, None, "http://u:p@localhost.example.org/"),
]


def test_screens(spark):
    urls = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, url string")
    basic = {r.i: r for r in screen_urls(urls).collect()}
    strict = {r.i: r for r in screen_urls(urls, level="strict").collect()}
    for i, (url, b, s, clean) in enumerate(CASES):
        assert basic[i].reason == b, url
        assert strict[i].reason == s, url
        assert basic[i].sanitised_url == (clean if b is None else None), url
        assert strict[i].sanitised_url == (clean or url if s is None else None), url


@pytest.mark.parametrize("url, feed", [
    ("https://a.example.org/RSS/x", True), ("https://a.example.org/a.atom", True), ("https://a.example.org/a.atom/b", False),
    ("https://a.example.org/x?type=Feed", True), ("https://a.example.org/x", False), ("https://a.example.org/xmlfile", True),
])
def test_feed_hint(spark, url, feed):
    row = screen_urls(spark.createDataFrame([(url,)], "url string"), level="strict").first()
    assert row.looks_like_feed is feed


def allowed(spark, policy, *pairs):
    df = spark.createDataFrame(list(pairs), "origin string, environment string")
    return [r.allowed for r in origin_audit(df, policy).collect()]


def test_origins_by_environment(spark):
    policy = OriginPolicy(("https://localhost:3000",), ("https://staging.example.com",), ("https://example.com",))
    got = allowed(
        spark, policy,
        ("https://localhost:3000", "development"), ("https://LOCALHOST:3000", "dev"), ("", "local"), (None, "dev"),
        ("https://evil.com", "dev"), ("https://localhost:3000", "who knows"), ("https://staging.example.com", "STAGE"),
        ("https://example.com", "prod"), ("https://example.com", "Production"), ("https://localhost:3000", "prod"),
        ("https://example.com", None),
    )
    assert got == [True, False, False, False, False, True, True, True, True, False, False]


def test_subdomains(spark):
    policy = OriginPolicy(("*.example.com",), allow_subdomains=True, domains=("example.com", "trusted.com"))
    got = allowed(spark, policy, *((o, "development") for o in (
        "https://example.com", "https://api.example.com", "https://test.example.com", "https://trusted.com",
        "https://api.trusted.com", "https://evil.com", "https://example.com.evil.com",
    )))
    assert got == [True] * 5 + [False] * 2


def test_rules_of_a_table_allow_what_the_policy_allows(spark):
    policy = OriginPolicy(("*.example.com", "http://localhost:3000"), ("https://s.example.com",), ("https://p.org",), allow_subdomains=True, domains=("trusted.com",))
    origins = ["https://example.com", "https://a.example.com", "https://a.b.example.com", "https://evil.com", "https://example.com.evil.com", "http://localhost:3000", "", None,
               "https://p.org", "https://x.p.org", "https://trusted.com", "http://x.trusted.com", "https://s.example.com", ".trusted.com", "trusted.com", "a..trusted.com"]
    df = spark.createDataFrame([(i, o, e) for i, (o, e) in enumerate((o, e) for o in origins for e in ("dev", "PROD", "stage", None) for _ in range(2))], "id int, origin string, environment string")
    key = lambda got: sorted((r.id, r.allowed) for r in got.collect())
    assert key(origin_audit_by_rules(df, origin_rules(spark, policy))) == key(origin_audit(df, policy))


def test_many_rules_make_a_hash_join(spark):
    many = spark.range(100_000).select(F.lit("development").alias("environment"), F.concat(F.lit(".d"), "id", F.lit(".example")).alias("text"), F.lit(True).alias("suffix"))
    asked = spark.range(1000).select("id", F.concat(F.lit("https://x.d"), F.col("id") * 150, F.lit(".example")).alias("origin"), F.lit("dev").alias("environment"))
    got = origin_audit_by_rules(asked, many)
    assert got.where("allowed").count() == 667 and got.count() == 1000
    odd = spark.createDataFrame([("development", None, True), (None, ".x", True), ("development", "example", True)], "environment string, text string, suffix boolean")
    assert origin_audit_by_rules(asked, odd).where("allowed").count() == 0
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
