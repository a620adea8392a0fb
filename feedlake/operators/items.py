"""Row transforms that turn raw feed entries into accepted items.

All of it is narrow: one scan, no shuffle.  The content hash is stored with the item, so duplicate
checks never have to read a description again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake import constants as C
from feedlake.functions import dates, urls
from feedlake.functions.text import is_blank, trim_space


def content_hash(title: Column, description: Column, author: Column) -> Column:
    """MD5 of the three texts run together, without a separator."""
    return F.md5(F.concat(title, description, author))


def normalize_items(raw: DataFrame, date_policy: str = "strict") -> DataFrame:
    """Raw entries to items: author default, date as RFC 3339 text, white space off both ends.

    ``strict`` reads RFC 1123 dates with numeric zone only and turns everything else into the zero
    time; ``lenient`` tries five formats and leaves an unreadable date blank (``pub_ts`` NULL).
    """
    text = {
        name: trim_space(F.coalesce(F.col(name), F.lit("")))
        for name in ("title", "link", "description")
    }
    text["author"] = trim_space(F.coalesce(F.col("author"), F.lit(C.UNKNOWN_AUTHOR)))
    published = F.coalesce(F.col("published"), F.lit(""))
    if date_policy == "strict":
        read, unreadable = dates.rfc1123z_to_ts(published), F.lit(C.ZERO_TIME_TEXT)
        as_text = dates.ts_to_rfc3339(F.col("pub_ts"), F.right("published", F.lit(5)))
    elif date_policy == "lenient":
        read, unreadable = dates.any_date_to_ts(trim_space(published)), F.lit("")
        as_text = dates.ts_to_rfc3339(F.col("pub_ts"))
    else:
        raise ValueError(f"unknown date policy {date_policy!r}")
    items = raw.withColumns({**text, "pub_ts": read}).withColumns({
        "pub_date": F.when(F.col("pub_ts").isNull(), unreadable).otherwise(as_text),
        "content_hash": content_hash(F.col("title"), F.col("description"), F.col("author")),
    }).drop("published")
    if date_policy == "strict":
        zero = F.lit(C.ZERO_TIME_TEXT).cast("timestamp")
        items = items.withColumn("pub_ts", F.coalesce("pub_ts", zero))
    return items


def validation_errors() -> Column:
    """Array of broken rules, in fixed order; lengths are bytes."""
    title, link = F.col("title"), F.col("link")
    pub_date = F.col("pub_date")
    return F.array_compact(F.array(
        F.when(is_blank(title), C.ERR_TITLE_EMPTY)
        .when(F.octet_length(title) > C.MAX_TITLE_BYTES, C.ERR_TITLE_LONG),
        F.when(is_blank(link), C.ERR_LINK_EMPTY)
        .when(~urls.is_request_uri(link), C.ERR_LINK_INVALID),
        F.when(F.octet_length("description") > C.MAX_DESCRIPTION_BYTES, C.ERR_DESCRIPTION_LONG),
        F.when(F.octet_length("author") > C.MAX_AUTHOR_BYTES, C.ERR_AUTHOR_LONG),
        F.when(~is_blank(pub_date) & ~dates.is_rfc3339(pub_date), C.ERR_PUB_DATE),
    ))


def is_valid_item(check_date: bool = True) -> Column:
    """The same rules as one predicate, cheap tests first, for the path that only keeps or drops."""
    link, pub_date = F.col("link"), F.col("pub_date")
    valid = (
        (F.octet_length("title") <= C.MAX_TITLE_BYTES)
        & (F.octet_length("description") <= C.MAX_DESCRIPTION_BYTES)
        & (F.octet_length("author") <= C.MAX_AUTHOR_BYTES)
        & ~is_blank(F.col("title"))
        & ~is_blank(link)
        & urls.is_request_uri(link)
    )
    return valid & (is_blank(pub_date) | dates.is_rfc3339(pub_date)) if check_date else valid


def validate_items(items: DataFrame) -> DataFrame:
    """Adds ``errors`` and the joined ``error`` text (NULL for an accepted item)."""
    checked = items.withColumn("errors", validation_errors())
    text = F.concat(F.lit(C.ERR_PREFIX), F.array_join("errors", ", "))
    return checked.withColumn("error", F.when(F.size("errors") > 0, text))


def accepted(items: DataFrame) -> DataFrame:
    return items.filter(is_valid_item())


def accept_entries(raw: DataFrame, date_policy: str = "strict") -> DataFrame:
    """Raw entries straight to accepted items; the date rule holds by construction, so it is not rerun."""
    return normalize_items(raw, date_policy).filter(is_valid_item(check_date=False))


def quarantined(items: DataFrame) -> DataFrame:
    return validate_items(items).filter(F.size("errors") > 0)
