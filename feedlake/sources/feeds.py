"""Bulk parsing of captured feed documents, batch or streaming (the job is narrow)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIALECTS = ("rss", "atom", "rdf", "json")

# Fields read from an item of each dialect.  A repeated element keeps its first value.
_ITEM = (
    "title: array<string>, link: array<string>, description: array<string>, pubDate: array<string>, "
    "author: array<struct<_VALUE: string, name: string>>, `itunes:author`: array<string>, `dc:creator`: array<string>, `dc:date`: array<string>"
)
_ENTRY = (
    "title: array<struct<_VALUE: string>>, link: array<struct<_href: string, _rel: string, _VALUE: string>>, "
    "summary: array<struct<_VALUE: string>>, content: array<struct<_VALUE: string>>, "
    "published: array<string>, updated: array<string>, author: array<struct<name: string>>"
)
_XML = {
    "rss": f"channel struct<title: array<string>, item: array<struct<{_ITEM}>>>",
    "rdf": f"item array<struct<{_ITEM}>>",
    "atom": f"entry array<struct<{_ENTRY}>>",
}
_JSON = (
    "version string, items array<struct<id: string, url: string, title: string, summary: string, content_text: string, content_html: string, "
    "date_published: string, date_modified: string, author: struct<name: string>, authors: array<struct<name: string>>>>"
)
_ROW_TAG = {"rss": "rss", "rdf": "rdf:RDF", "atom": "feed"}
_CORRUPT = "_corrupt_record"
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
_XML_OPTIONS = {**_OPTIONS, "ignoreSurroundingSpaces": "false", "nullValue": "\u0000", "attributePrefix": "_"}


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def dialect_of(body: Column) -> Column:
    """Dialect by the root of the document, in any letter case; NULL when it is none of them."""
    head = F.regexp_replace(F.ltrim(body), r"^﻿", "")
    root = F.lower(F.regexp_extract(head, r"(?s)^(?:<\?.*?\?>|<!--.*?-->|<!(?i:DOCTYPE)[^>]*>|\s)*<([A-Za-z:]+)", 1))
    return (
        F.when(head.startswith("{"), "json").when(root == "rss", "rss").when(root == "feed", "atom").when(root.isin("rdf:rdf", "rdf"), "rdf")
    )


def author_name(text: Column) -> Column:
    """The name in ``mail (Name)`` or ``Name <mail>``, else the text as it is."""
    bracketed = F.regexp_extract(text, r"^\s*[^\s()]+@[^\s()]+\s*\((.*)\)\s*$", 1)
    before = F.regexp_extract(text, r"^\s*(.*?)\s*<[^<>\s]+@[^<>\s]+>\s*$", 1)
    return F.when(bracketed != "", bracketed).when(before != "", before).otherwise(text)


def _of_item(e: Column) -> dict[str, Column]:
    author = _first(e["author"])
    return {
        "title": _first(e["title"]), "link": _first(e["link"]), "description": _first(e["description"]),
        "author": F.coalesce(author["name"], author_name(author["_VALUE"]), _first(e["itunes:author"]), _first(e["dc:creator"])),
        "published": F.coalesce(_first(e["pubDate"]), _first(e["dc:date"])),
    }


def _of_entry(e: Column) -> dict[str, Column]:
    page = F.filter(e["link"], lambda l: l["_rel"].isNull() | (l["_rel"] == "alternate"))  # noqa: E741
    return {
        "title": _first(e["title"])["_VALUE"], "link": F.coalesce(_first(page)["_href"], _first(e["link"])["_href"]),
        "description": F.coalesce(_first(e["summary"])["_VALUE"], _first(e["content"])["_VALUE"]), "author": _first(e["author"])["name"],
        "published": F.coalesce(_first(e["published"]), _first(e["updated"])),
    }


def _of_json(e: Column) -> dict[str, Column]:
    return {
        "title": e["title"], "link": F.coalesce(e["url"], e["id"]), "description": F.coalesce(e["summary"], e["content_text"], e["content_html"]),
        "author": F.coalesce(_first(e["authors"])["name"], e["author"]["name"]), "published": F.coalesce(e["date_published"], e["date_modified"]),
    }


def _read(documents: DataFrame, body: str, dialect: str) -> DataFrame:
    """``documents`` without the body, with ``kind``, ``entries`` and ``reason`` (why it can't be read, or NULL).

    What the readers return goes through a generator of one row: filters and projections above it take
    fields of a value that is there, where they would otherwise repeat the readers.
    """
    if dialect not in (*DIALECTS, "detect"):
        raise ValueError(f"unknown dialect {dialect!r}")
    keep = [c for c in documents.columns if c != body]
    kinds = DIALECTS if dialect == "detect" else (dialect,)
    seen = documents.withColumn("_root", dialect_of(F.col(body)))
    seen = seen.withColumn("_kind", F.col("_root") if dialect == "detect" else F.lit(dialect))

    def reader(k: str) -> Column:
        text = F.when((F.col("_kind") == k) & (F.col("_root") == k), F.col(body))
        if k == "json":
            return F.from_json(text, f"{_JSON}, {_CORRUPT} string", _OPTIONS)
        return F.from_xml(text, f"{_XML[k]}, {_CORRUPT} string", {**_XML_OPTIONS, "rowTag": _ROW_TAG[k]})

    read = F.struct(F.col("_kind").alias("kind"), F.col("_root").alias("root"), *(reader(k).alias(k) for k in kinds))
    docs = seen.select(*keep, F.explode(F.array(read)).alias("_read"))
    of = {k: F.col("_read")[k] for k in kinds}
    shape = {"rss": (lambda d: d["channel"]["item"], _of_item), "rdf": (lambda d: d["item"], _of_item), "atom": (lambda d: d["entry"], _of_entry), "json": (lambda d: d["items"], _of_json)}

    def entries(k: str) -> Column:
        values, fields = shape[k]
        return F.transform(values(of[k]), lambda e: F.struct(*(v.alias(n) for n, v in fields(e).items())))

    kind = F.col("_read.kind")
    broken = F.coalesce(*(of[k][_CORRUPT] for k in kinds)).isNotNull()
    unread = F.when(kind.isNull() | F.coalesce(F.col("_read.root") != kind, F.lit(True)), "unknown format").when(broken, "malformed document")
    return docs.select(*keep, kind.alias("kind"), unread.alias("reason"), F.coalesce(*(entries(k) for k in kinds)).alias("entries"))


def parse_feed_documents(documents: DataFrame, body: str = "body", dialect: str = "detect") -> DataFrame:
    """One raw entry per item of each document; the other columns of ``documents`` are kept.

    Adds ``position`` (place in the document), title, link, description, author and published.  A
    missing author stays NULL, an empty author name stays empty.  ``dialect`` is ``rss`` (2.0),
    ``atom``, ``rdf`` (RSS 1.0), ``json`` (JSON Feed), or ``detect``: each document by its root.
    Documents that can't be read give no entries here and a row in :func:`parse_failures`.
    """
    keep = [c for c in documents.columns if c != body]
    read = _read(documents, body, dialect).where("reason is null")
    return read.select(*keep, F.posexplode("entries").alias("position", "e")).select(*keep, "position", "e.*")


def parse_failures(documents: DataFrame, body: str = "body", dialect: str = "detect") -> DataFrame:
    """One row for every document that can't be read, with the reason."""
    keep = [c for c in documents.columns if c != body]
    return _read(documents, body, dialect).where("reason is not null").select(*keep, "reason")


# --- files of any size ------------------------------------------------------------------------------

# Element of an entry, its fields, how they are taken, and the end tags that may follow the last one.
_ELEMENT = {
    "rss": ("item", _ITEM, _of_item, "channel|rss"), "rdf": ("item", _ITEM, _of_item, "channel|rdf:rdf|rdf"), "atom": ("entry", _ENTRY, _of_entry, "feed"),
}


def _element(dialect: str) -> tuple:
    if dialect not in _ELEMENT:
        raise ValueError(f"no end tag to cut {dialect!r} at")
    return _ELEMENT[dialect]


def feed_file_pieces(spark: SparkSession, path: str, dialect: str = "rss", end_tag: str | None = None, stream: bool = False) -> DataFrame:
    """The text of feed files cut behind each entry, for :func:`parse_pieces`: ``piece`` with the columns of partitioned
    folders and ``piece_at``, by which pieces are in order of files and in them: ``file``, ``block`` (where
    the part of the file that a task reads begins), ``row`` within it (not in a ``stream``) and ``part``.

    Files are split over tasks like any text, and a task holds an entry at a time.  End tags are spelled like
    ``end_tag`` (``</item>`` or ``</entry>``) as a rule; others are cut at as well, but only in memory.
    """
    element = _element(dialect)[0]
    reader = (spark.readStream if stream else spark.read).option("lineSep", end_tag or f"</{element}>")
    text = reader.text(path)
    keep = [c for c in text.columns if c != "value"]
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    if not stream:
        place.append(F.monotonically_increasing_id().alias("row"))
    cut = text.select(*keep, F.struct(*place).alias("_place"), F.posexplode(F.split("value", rf"(?i)</{element}\s*>")).alias("_part", "piece"))
    return cut.select(*keep, F.col("_place").withField("part", F.col("_part")).alias("piece_at"), "piece")


def _read_pieces(pieces: DataFrame, dialect: str) -> DataFrame:
    """``pieces`` without the text, with ``entry`` and ``reason``; parts of a file that hold no entry are left out."""
    element, schema, fields, ends = _element(dialect)
    keep = [c for c in pieces.columns if c != "piece"]
    # no look further than the start tag: what is before it is the feed's own title or white space
    entry = F.nullif(F.regexp_extract("piece", rf"(?is)<{element}[\s>].*", 0), F.lit(""))
    value = F.from_xml(F.concat(entry, F.lit("</"), F.regexp_extract(entry, r"^<(\w+)", 1), F.lit(">")), f"struct<{schema}, {_CORRUPT}: string>", {**_XML_OPTIONS, "rowTag": element})
    rest = F.col("piece").rlike(rf"(?i)^\s*$|</(?:{ends})\s*>")
    read = F.struct(entry.isNull().alias("none"), rest.alias("rest"), value.alias("value"))
    read = pieces.select(*keep, F.explode(F.array(read)).alias("_read")).where("not (_read.none and _read.rest)")
    broken = F.col("_read.none") | F.col(f"_read.value.{_CORRUPT}").isNotNull()
    found = F.struct(*(v.alias(n) for n, v in fields(F.col("_read.value")).items()))
    return read.select(*keep, F.when(broken, "malformed entry").alias("reason"), found.alias("entry"))


def parse_pieces(pieces: DataFrame, dialect: str = "rss") -> DataFrame:
    """The raw entries of :func:`feed_file_pieces`, with fields as in :func:`parse_feed_documents`.

    An entry that can't be read costs only itself and has a row in :func:`piece_failures`, unlike in a document that
    is read as a whole.  End tags within CDATA cut their entry in two failures.  Of a file that ends within an
    entry, the last one counts if it ends behind one of its elements.
    """
    return _read_pieces(pieces, dialect).where("reason is null").drop("reason").select("*", "entry.*").drop("entry")


def piece_failures(pieces: DataFrame, dialect: str = "rss") -> DataFrame:
    """One row for every piece that should be an entry and can't be read."""
    return _read_pieces(pieces, dialect).where("reason is not null").drop("entry")
