"""Filters, ordering and pages over stored items."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake import constants as C
from feedlake.functions import dates
from feedlake.schemas import ITEM_TEXT


def newest_first() -> list[Column]:
    """Newest publication first; equal instants by link, so that pages are repeatable."""
    return [F.col("pub_ts").desc_nulls_last(), F.col("link").asc()]


def filter_source(items: DataFrame, source: str) -> DataFrame:
    """Links strictly between ``source`` and ``source`` + U+FFFD: a prefix range, both ends excluded."""
    link = F.col("link")
    return items.filter((link > source) & (link < source + C.PREFIX_RANGE_END))


def filter_author(items: DataFrame, author: str) -> DataFrame:
    return items.filter(F.col("author") == author)


def filter_links(items: DataFrame, links: Sequence[str]) -> DataFrame:
    """The items of some links; up to ten are looked up in the Bloom filters of a lookup table's row groups."""
    return items.filter(F.col("link").isin(*links)) if links else items.limit(0)


def _month(text: str) -> Column:
    """First day of an instant's month: no partition of a day or month that holds it begins earlier."""
    return F.lit(dates.utc_date(text).replace(day=1))


def filter_dates(items: DataFrame, date_from: str = "", date_to: str = "") -> DataFrame:
    """Publication instant within inclusive RFC 3339 bounds; ValueError for a malformed bound.

    On the serving table the bounds are repeated for ``pub_part``, so other directories aren't read.
    """
    parts = "pub_part" in items.columns
    if date_from:
        items = items.filter(F.col("pub_ts") >= dates.instant(date_from))
        items = items.filter(F.col("pub_part") >= _month(date_from)) if parts else items
    if date_to:
        items = items.filter(F.col("pub_ts") <= dates.instant(date_to))
        items = items.filter(F.col("pub_part") <= F.lit(dates.utc_date(date_to))) if parts else items
    return items


def filter_keyword(items: DataFrame, keyword: str) -> DataFrame:
    """Case-insensitive literal substring of title or description."""
    word = F.lower(F.lit(keyword))
    return items.filter(
        F.lower(F.col("title")).contains(word) | F.lower(F.col("description")).contains(word)
    )


@dataclass(frozen=True)
class ItemFilter:
    source: str = ""
    author: str = ""
    date_from: str = ""
    date_to: str = ""
    keyword: str = ""

    def stored(self, items: DataFrame) -> DataFrame:
        """Everything but the keyword: predicates the scan can use."""
        if self.source:
            items = filter_source(items, self.source)
        if self.author:
            items = filter_author(items, self.author)
        return filter_dates(items, self.date_from, self.date_to)

    def with_keyword(self, items: DataFrame) -> DataFrame:
        return filter_keyword(items, self.keyword) if self.keyword else items


@dataclass(frozen=True)
class PageRequest:
    limit: int = C.DEFAULT_PAGE
    offset: int = 0
    cursor: str = ""

    @property
    def size(self) -> int:
        return C.DEFAULT_PAGE if self.limit <= 0 else min(self.limit, C.MAX_PAGE)

    @property
    def start(self) -> int:
        """Rows to skip: a well-formed cursor overrides the offset, anything else is ignored."""
        start = self.offset
        found = re.fullmatch(re.escape(C.CURSOR_PREFIX) + "([+-]?[0-9]+)", self.cursor)
        if found:
            start = int(found[1])
        return max(start, 0)


def page_items(items: DataFrame, request: PageRequest = PageRequest()) -> DataFrame:
    """One page in order.  Each task keeps ``start + size`` rows at most (top-k, no full sort); a start
    beyond ``DEEP_START`` is found by counts first."""
    if request.start > DEEP_START:
        return seek_page(items, request)
    page = items.orderBy(*newest_first())
    if request.start:
        page = page.offset(request.start)
    return page.limit(request.size)


# Rows that a page may skip in every task; a deeper one is sought.
DEEP_START = 20_000
SLICES = 256


def _walk(groups: list[tuple], skip: int) -> tuple[int, int]:
    """Which of the (.., rows) groups in order holds the row after ``skip`` others, and the rows before that group."""
    before = 0
    for k, (*_, rows) in enumerate(groups):
        if before + rows > skip or k == len(groups) - 1:
            return k, before
        before += rows
    return 0, 0


def seek_page(items: DataFrame, request: PageRequest, slice_rows: int | None = None) -> DataFrame:
    """The page of :func:`page_items` without its tasks holding ``start`` rows.

    Counts lead to the page: of the partitions (from file footers, where the scan has ``pub_part``), then of
    equal slices of time, then, among items of one instant or without one, of links by their next character.
    Each step counts within the slice that the step before has found, over one or two columns; the
    page is then ordered from that slice on.
    """
    skip, size, slice_rows = request.start, request.size, slice_rows or DEEP_START
    rows, us = items, F.unix_micros("pub_ts")
    if "pub_part" in items.columns:
        parts = [(r.pub_part, r["count"]) for r in items.groupBy("pub_part").count().collect()]
        parts.sort(key=lambda p: (p[0] is None, -p[0].toordinal() if p[0] else 0))
        if parts:
            first, before = _walk(parts, skip)
            last, _ = _walk(parts, skip + size - 1)
            skip -= before
            day = F.col("pub_part")
            later = day.isNull() if parts[first][0] is None else (day <= F.lit(parts[first][0])) | day.isNull()
            sooner = F.lit(True) if parts[last][0] is None else day >= F.lit(parts[last][0])
            rows = rows.filter(later & sooner)
    dated, low, high = rows.agg(F.count("pub_ts"), F.min(us), F.max(us)).first()
    undated = skip >= dated
    if undated:
        skip -= dated
        rows = tied = rows.filter(F.col("pub_ts").isNull())
        held = tied.count()
    else:
        held = dated
        while held > slice_rows and low < high:
            width = max(1, -(-(high - low + 1) // SLICES))
            inside = rows.filter((us >= low) & (us <= high)).groupBy(F.expr(f"(unix_micros(pub_ts) - {low}L) div {width}L").alias("nth"))
            slices = [(r.low, r.high, r.n) for r in inside.agg(F.min(us).alias("low"), F.max(us).alias("high"), F.count(F.lit(1)).alias("n")).collect()]
            slices.sort(reverse=True)
            k, before = _walk(slices, skip)
            skip -= before
            low, high, held = slices[k]
        rows = rows.filter((us <= high) | F.col("pub_ts").isNull())
        tied = rows.filter(us == high)
    if held > slice_rows:  # of one instant, or without one
        prefix = ""
        while held > slice_rows:
            least, most = tied.agg(F.min("link"), F.max("link")).first()
            if least == most:
                break
            shared = next((i for i, (a, b) in enumerate(zip(least, most)) if a != b), min(len(least), len(most)))
            groups = [(r.c, r["count"]) for r in tied.groupBy(F.substring("link", shared + 1, 1).alias("c")).count().collect()]
            groups.sort()
            k, before = _walk(groups, skip)
            skip -= before
            prefix, held = least[:shared] + groups[k][0], groups[k][1]
            tied = tied.filter(F.substring("link", 1, shared + 1) == prefix)
        behind = F.col("link") >= prefix
        rows = rows.filter(behind if undated else behind | (us < high) | F.col("pub_ts").isNull())
    page = rows.orderBy(*newest_first())
    return (page.offset(skip) if skip > 0 else page).limit(size)


def latest_items(items: DataFrame) -> DataFrame:
    return page_items(items, PageRequest(limit=C.MAX_PAGE))


def keyset_page(items: DataFrame, after_ts: str | None, after_link: str, limit: int = C.DEFAULT_PAGE) -> DataFrame:
    """The page behind (``after_ts``, ``after_link``): cost does not grow with page depth.

    Undated items come last; behind one of them ``after_ts`` is None.
    """
    undated = F.col("pub_ts").isNull()
    if after_ts is None:
        return page_items(items.filter(undated & (F.col("link") > after_link)), PageRequest(limit=limit))
    ts = dates.instant(after_ts)
    behind = (F.col("pub_ts") < ts) | ((F.col("pub_ts") == ts) & (F.col("link") > after_link))
    # the plain bounds repeat what the OR implies, in a form the scan can use
    items = items.filter((F.col("pub_ts") <= ts) | undated)
    if "pub_part" in items.columns:
        items = items.filter((F.col("pub_part") <= F.lit(dates.utc_date(after_ts))) | F.col("pub_part").isNull())
    return page_items(items.filter(behind | undated), PageRequest(limit=limit))


def items_page(
    items: DataFrame,
    wanted: ItemFilter = ItemFilter(),
    request: PageRequest = PageRequest(),
    keyword_mode: str = "post_page",
) -> DataFrame:
    """One row: ``items`` (ordered array), ``total_count``, ``has_more``, ``next_cursor``.

    ``post_page`` applies the keyword to the fetched page only, and neither the total nor the page
    bounds know of it; ``pre_page`` filters first, so pages do not overlap.
    """
    if keyword_mode not in ("post_page", "pre_page"):
        raise ValueError(f"unknown keyword mode {keyword_mode!r}")
    stored = wanted.stored(items)
    if keyword_mode == "pre_page":
        stored = wanted.with_keyword(stored)
    fetched = page_items(stored, request)
    title_or_text = F.lit(True)
    if wanted.keyword and keyword_mode == "post_page":
        word = F.lower(F.lit(wanted.keyword))
        title_or_text = (
            F.lower(F.col("title")).contains(word) | F.lower(F.col("description")).contains(word)
        )
    entry = F.struct(*(F.col(c) for c in ITEM_TEXT))
    ranked = F.struct(
        F.col("pub_ts").isNull().alias("undated"), (-F.unix_micros("pub_ts")).alias("age"), F.col("link").alias("tie"), entry.alias("item")
    )
    # at most 1000 rows reach this aggregate: the page size is capped
    page = fetched.agg(
        F.count(F.lit(1)).alias("fetched"),
        F.sort_array(F.collect_list(F.when(title_or_text, ranked))).alias("kept"),
    )
    total = stored.agg(F.count(F.lit(1)).alias("n")).scalar()
    reached = F.lit(request.start) + F.size("kept")
    out = page.select("fetched", "kept", total.alias("total_count"))
    out = out.withColumn("has_more", reached < F.col("total_count"))
    cursor = F.concat(F.lit(C.CURSOR_PREFIX), reached.cast("string"))
    return out.select(
        F.transform("kept", lambda r: r["item"]).alias("items"),
        "total_count",
        "has_more",
        F.when(F.col("has_more") & (F.col("fetched") > 0), cursor).otherwise("").alias("next_cursor"),
    )
