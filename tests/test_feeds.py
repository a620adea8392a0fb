"""Feed formats, detection and what can't be read."""

import re

import pytest

from feedlake import constants as C
from feedlake.session import work_dir
from feedlake.sources import catalog, feeds

RSS = '<?xml version="1.0"?>\n<!-- made by hand --><rss version="2.0"><channel><title>c</title><item><title>t</title><link>l</link><description>d &amp; e</description>{}<pubDate>p</pubDate></item></channel></rss>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="text">t</title><link rel="alternate" href="l"/><content>d</content><author><name>n</name></author><updated>u</updated></entry></feed>'
RDF = '<rdf:RDF><channel/><item><title>t</title><link>l</link><dc:creator>n</dc:creator><dc:date>p</dc:date></item><item><title>second</title></item></rdf:RDF>'
JSON = '{"version": "https://jsonfeed.org/version/1", "items": [{"id": "l", "title": "t", "content_text": "d", "author": {"name": "n"}, "date_modified": "m"}]}'


def frame(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "n int, body string")


@pytest.mark.parametrize("author, name", [
    ("<author>desk@example.org (Ann B.)</author>", "Ann B."), ("<author>Ann &lt;a@example.org&gt;</author>", "Ann"), ("<author>a@example.org</author>", "a@example.org"),
    ("<author>Ann</author>", "Ann"), ("<author><name>Ann</name></author>", "Ann"), ("<itunes:author>Ann</itunes:author>", "Ann"), ("<dc:creator>Ann</dc:creator>", "Ann"), ("", None),
])
def test_author_names(spark, author, name):
    row = feeds.parse_feed_documents(frame(spark, RSS.format(author))).first()
    assert (row.title, row.link, row.description, row.author, row.published) == ("t", "l", "d & e", name, "p")


def test_each_document_by_its_own_format(spark):
    rows = feeds.parse_feed_documents(frame(spark, RSS.format(""), ATOM, RDF, JSON)).orderBy("n", "position").collect()
    assert [(r.n, r.position, r.title, r.author, r.published) for r in rows] == [
        (0, 0, "t", None, "p"), (1, 0, "t", "n", "u"), (2, 0, "t", "n", "p"), (2, 1, "second", None, None), (3, 0, "t", "n", "m"),
    ]


def test_nothing_unreadable_vanishes(spark):
    bodies = [RSS.format("")[:120], "plain text", None, "", ATOM, '{"version": ', "<html><body/></html>", RSS.format("")]
    found = {r.n: r.reason for r in feeds.parse_failures(frame(spark, *bodies)).collect()}
    assert found == {0: "malformed document", 1: "unknown format", 2: "unknown format", 3: "unknown format", 5: "malformed document", 6: "unknown format"}
    assert {r.n for r in feeds.parse_feed_documents(frame(spark, *bodies)).collect()} == {4, 7}
    assert [r.reason for r in feeds.parse_failures(frame(spark, ATOM), dialect="rss").collect()] == ["unknown format"]
    with pytest.raises(ValueError):
        feeds.parse_failures(frame(spark, ATOM), dialect="gopher")


def test_catalog_forms_and_fallback(spark):
    path = work_dir(spark, "test-catalog")
    spark.createDataFrame([('[\n {"name": "a", "url": "u"},\n {"name": "b", "url": "v"}\n]',)], "value string").coalesce(1).write.text(path)
    assert {tuple(r) for r in catalog.read_feed_catalog(spark, path).collect()} == {("a", "u"), ("b", "v")}
    missing = catalog.read_feed_catalog(spark, work_dir(spark, "no-catalog")).collect()
    assert [tuple(r) for r in missing] == list(C.FALLBACK_FEEDS)


@pytest.mark.parametrize("dialect", ["detect", "rss"])
def test_every_reader_runs_once_in_the_plan(spark, dialect):
    docs = spark.createDataFrame([("u", "<rss><channel><item><title>a</title></item></channel></rss>")], "feed_url string, body string").repartition(2)
    parsed = feeds.parse_feed_documents(docs, dialect=dialect)
    plan = parsed.where("title = 'a'")._jdf.queryExecution().optimizedPlan().toString().lower()
    readers = {"detect": (3, 1), "rss": (1, 0)}[dialect]
    assert (len(re.findall(r"from_xml\(|xmltostructs\(|xml_to_structs\(", plan)), len(re.findall(r"from_json\(|jsontostructs\(", plan))) == readers, plan


def test_roots_and_elements_in_any_case(spark):
    rows = [
        ("a", '<RSS version="2.0"><CHANNEL><ITEM><TITLE>T</TITLE><Link>http://x</Link><PUBDATE>p</PUBDATE></ITEM></CHANNEL></RSS>'),
        ("b", '<Feed xmlns="http://www.w3.org/2005/Atom"><Entry><Title>t2</Title><LINK HREF="http://y"/></Entry></Feed>'), ("c", "<Html><rss/></Html>"),
    ]
    docs = spark.createDataFrame(rows, "feed_url string, body string")
    got = {r.feed_url: (r.title, r.link, r.published) for r in feeds.parse_feed_documents(docs).collect()}
    assert got == {"a": ("T", "http://x", "p"), "b": ("t2", "http://y", None)}
    assert [(r.feed_url, r.reason) for r in feeds.parse_failures(docs).collect()] == [("c", "unknown format")]


FILE_OF = {
    "rss": ('<?xml version="1.0"?>\n<rss><channel><title>the feed</title>', "<item n='{n}'>\n<title>t{n} &amp; ü</title><link>l{n}</link></item>", "</channel></rss>\n"),
    "rdf": ('<rdf:RDF><channel><items><rdf:Seq/></items></channel>', "<item rdf:about='x'><title>t{n} &amp; ü</title><link>l{n}</link><dc:creator>n</dc:creator></item>\n", "</rdf:RDF>"),
    "atom": ('<feed xmlns="http://www.w3.org/2005/Atom"><title>the feed</title>', '<entry><title type="text">t{n} &amp; ü</title><link href="l{n}"/></entry>', "</feed>"),
}


def one_file(spark, text, folder="feed_url=a"):
    path = work_dir(spark, "test-feed-file")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(f"{path}/{folder}")
    return path


@pytest.mark.parametrize("dialect", ["rss", "rdf", "atom"])
def test_one_large_file_is_split_over_tasks(spark, dialect):
    head, entry, tail = FILE_OF[dialect]
    text = head + "".join(entry.format(n=n) for n in range(400)) + tail
    whole = [tuple(r) for r in feeds.parse_feed_documents(spark.createDataFrame([("a", text)], "feed_url string, body string")).orderBy("position").drop("position").collect()]
    path, size = one_file(spark, text), spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for part in (701, 2_048):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(part))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            pieces = feeds.feed_file_pieces(spark, path, dialect)
            assert pieces.rdd.getNumPartitions() > 10
            got = [tuple(r) for r in feeds.parse_pieces(pieces, dialect).orderBy("piece_at").drop("piece_at").collect()]
            assert len(got) == 400 and got == whole
            assert feeds.piece_failures(pieces, dialect).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_spellings_of_tags_and_entries_that_cannot_be_read(spark):
    good = "<item><title>{}</title><link>l</link></item>"
    text = ("<RSS><channel>" + good.format("a") + "<ITEM><TITLE>b</TITLE></ITEM><item><title>c</title></item ><item><title>d</item>" + good.format("e")
            + "<item><description><![CDATA[an </item> within]]></description></item>" + good.format("f") + "<item></item></channel></RSS>")
    pieces = feeds.feed_file_pieces(spark, one_file(spark, text))
    titles = [r.title for r in feeds.parse_pieces(pieces).orderBy("piece_at").collect()]
    assert titles == ["a", "b", "c", "e", "f", None]
    assert [r.reason for r in feeds.piece_failures(pieces).collect()] == ["malformed entry"] * 3
    for text in ("", "<rss><channel></channel></rss>", "<rss><channel><title>t</title><item/></channel></rss>"):
        empty = feeds.feed_file_pieces(spark, one_file(spark, text))
        assert feeds.parse_pieces(empty).isEmpty() and feeds.piece_failures(empty).isEmpty()
    assert feeds.piece_failures(feeds.feed_file_pieces(spark, one_file(spark, "503 try again later"))).count() == 1
    with pytest.raises(ValueError):
        feeds.feed_file_pieces(spark, "x", "json")


def test_an_end_tag_of_its_own_spelling(spark):
    path = one_file(spark, "<rss><channel>" + "<ITEM><title>t</title></ITEM>" * 50 + "</channel></rss>")
    pieces = feeds.feed_file_pieces(spark, path, end_tag="</ITEM>")
    assert pieces.select("piece_at.row").distinct().count() == 51 and feeds.parse_pieces(pieces).count() == 50


def test_pieces_read_once_in_the_plan(spark):
    parsed = feeds.parse_pieces(feeds.feed_file_pieces(spark, one_file(spark, "<rss/>")))
    plan = parsed.where("title = 'a' and link is not null")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert len(re.findall(r"from_xml\(|xmltostructs\(|xml_to_structs\(", plan)) == 1, plan
