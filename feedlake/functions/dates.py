"""Publication-date parsing.

Weekday patterns make the JVM formatter throw even inside ``try_to_timestamp``, so a pattern test
vouches for the weekday and only the rest of the text is handed to the formatter (which rejects
31 February).  A Spark timestamp forgets the offset it was read with, so the offset is put back from
the text.  All of it expects the session time zone to be UTC.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_WEEKDAY = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_STAMP = rf"(?i:{_WEEKDAY}), \d{{2}} (?i:{_MONTH}) \d{{4}} \d{{1,2}}:\d{{2}}:\d{{2}}(?:[.,]\d+)?"
RFC1123Z = rf"^{_STAMP} [+-]\d{{4}}$"
RFC1123 = rf"^{_STAMP} (?:[A-Z]{{3}}|[A-Z]{{3}}T|GMT[+-]\d{{1,2}})$"
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})$"
PLAIN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d+)?$"


def _behind_weekday(col: Column) -> Column:
    """``Mon, 02 JAN 2006 15:04:05.9 …`` to ``02 Jan 2006 15:04:05 …``."""
    return F.initcap(F.regexp_replace(F.regexp_replace(col, r"^[A-Za-z]{3}, ", ""), r"[.,]\d+", ""))


def rfc1123z_to_ts(col: Column) -> Column:
    """RFC 1123 text with numeric zone to an instant; NULL when unparsable."""
    parsed = F.try_to_timestamp(_behind_weekday(col), F.lit("dd MMM yyyy H:mm:ss Z"))
    return F.when(col.rlike(RFC1123Z), parsed)


def ts_to_rfc3339(ts: Column, zone: Column | None = None) -> Column:
    """RFC 3339 text of an instant, in UTC or in the ``±hhmm`` offset ``zone``."""
    if zone is None:
        return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    minutes = F.concat(F.left(zone, F.lit(1)), F.right(zone, F.lit(2))).cast("int")
    shift = F.make_dt_interval(hours=F.left(zone, F.lit(3)).cast("int"), mins=minutes)
    suffix = F.concat(F.left(zone, F.lit(3)), F.lit(":"), F.right(zone, F.lit(2)))
    return F.when(F.right(zone, F.lit(4)) == "0000", ts_to_rfc3339(ts)).otherwise(
        F.concat(F.date_format(ts + shift, "yyyy-MM-dd'T'HH:mm:ss"), suffix)
    )


def rfc3339_to_ts(col: Column) -> Column:
    """RFC 3339 text to an instant (to the microsecond); NULL when unparsable."""
    return F.when(col.rlike(RFC3339), F.replace(col, F.lit(","), F.lit(".")).try_cast("timestamp"))


def is_rfc3339(col: Column) -> Column:
    return F.coalesce(rfc3339_to_ts(col).isNotNull(), F.lit(False))


def any_date_to_ts(col: Column) -> Column:
    """The tolerant reading: five formats tried in order, NULL when none fits.

    RFC 3339, RFC 1123 with numeric zone, RFC 1123 with zone name (a name carries no offset, except
    ``GMT+h``), and date-time without zone, read as UTC.  The fifth, ``…T…Z``, is inside RFC 3339.
    """
    clock = F.substring_index(_behind_weekday(col), " ", 4)
    gmt_hours = F.regexp_extract(col, r"GMT([+-]\d{1,2})$", 1)
    shift = F.make_dt_interval(hours=F.when(gmt_hours != "", gmt_hours.cast("int")).otherwise(0))
    named = F.when(
        col.rlike(RFC1123), F.try_to_timestamp(clock, F.lit("dd MMM yyyy H:mm:ss")) - shift
    )
    plain = F.when(col.rlike(PLAIN), F.replace(col, F.lit(","), F.lit(".")).try_cast("timestamp"))
    return F.coalesce(rfc3339_to_ts(col), rfc1123z_to_ts(col), named, plain)


def instant(text: str) -> Column:
    """A literal instant from RFC 3339 text, truncated to the second; ValueError when malformed."""
    return F.timestamp_micros(F.lit(instant_us(text)))


def utc_date(text: str) -> date:
    """Calendar day, in UTC, of an instant in RFC 3339 text."""
    return (datetime(1970, 1, 1) + timedelta(microseconds=instant_us(text))).date()


def instant_us(text: str) -> int:
    if not re.match(RFC3339, text):
        raise ValueError(f"expected RFC3339 text, got {text!r}")
    whole = re.sub(r"[.,]\d+", "", text).replace("Z", "+00:00")
    moment = datetime.fromisoformat(whole)
    seconds = (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()
    return int(seconds) * 1_000_000
