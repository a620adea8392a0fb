"""URL tests and splitting by pattern.

``parse_url`` is of no use here: it yields NULL as soon as the query holds a character such as ``<``,
which is just what screening looks for.  Each question below is one compiled pattern over the text,
which also keeps the generated code small.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CTL = r"\x00-\x1f\x7f"
_SCHEME = "[a-zA-Z][a-zA-Z0-9+.-]*:"
_BAD_ESCAPE = "%(?![0-9a-fA-F]{2})"
# ASCII that may not stand in a host (a percent escape there stands for a byte above 0x7F), and what
# user information may hold.
_NOT_HOST = r"""(?:[\x00-\x7f&&[^a-zA-Z0-9_.~!$&'()*+,;=:\[\]<>"%-]]|%[0-7])"""
_USER = r"[a-zA-Z0-9_.:~!$&'()*+,;=%@-]"


def _authority_faults(start: str, stop: str) -> list[str]:
    """Patterns of what is wrong between ``//`` and the path; ``stop`` ends the authority.

    All patterns here look for a fault by scanning, in time linear in the text.  A pattern for the
    whole of a good URL would repeat a group per character and overflow the matcher's stack on a long
    URL.
    """
    part, end = f"[^{stop}]", rf"(?:[{stop}]|\z)"
    host = rf"{start}(?:{part}*@)?+"
    return [
        rf"{start}{_USER}*+{part}*@",
        rf"{host}{part}*(?=[^{stop}]){_NOT_HOST}",
        rf"{host}\[(?!{part}*\](?::\d*)?{end})",
        rf"{host}(?!\[){part}*:[^:{stop}]*[^:0-9{stop}][^:{stop}]*{end}",
    ]


# Not a URL at all: control characters, bad escapes outside the query, a colon in a first segment
# that is no scheme, or a faulty authority.
UNPARSABLE = "|".join([
    rf"^[^#]*[{_CTL}]",
    rf"^(?!{_SCHEME}(?!/))[^?#]*{_BAD_ESCAPE}",
    rf"^[^#]*#[\s\S]*{_BAD_ESCAPE}",
    rf"^(?!{_SCHEME})[^/?#]*:",
    *_authority_faults(rf"^(?:{_SCHEME})?//", "/?#"),
])
# Not what an HTTP request line may hold: that is absolute or rooted, and ``#`` is an ordinary character.
NOT_REQUEST_TARGET = "|".join([
    rf"^(?!{_SCHEME}|/|\*\z)",
    rf"[{_CTL}]",
    rf"^(?!{_SCHEME}(?!/))[^?]*{_BAD_ESCAPE}",
    *_authority_faults(rf"^{_SCHEME}//", "/?"),
])
_PLAIN_PATH = r"^[a-zA-Z0-9_.~$&+,/:;=@!'()*\[\]%-]*$"
_PLAIN_FRAGMENT = r"^[a-zA-Z0-9_.~$&+,/:;=?@!'()*\[\]%-]*$"


def is_parsable(url: Column) -> Column:
    return ~url.rlike(UNPARSABLE)


def is_request_uri(col: Column) -> Column:
    return ~col.rlike(NOT_REQUEST_TARGET)


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, rf"^({_SCHEME[:-1]}):", 1))


def authority_of(url: Column) -> Column:
    return F.regexp_extract(url, rf"^(?:{_SCHEME})?//([^/?#]*)", 1)


def host_of(url: Column) -> Column:
    """Host with port, user information removed."""
    return F.substring_index(authority_of(url), "@", -1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, rf"^(?:{_SCHEME})?(?://[^/?#]*)?([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def decoded_path(path: Column) -> Column:
    """Percent escapes decoded; ``+`` stays a plus sign in a path."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def sanitised(url: Column, scheme: Column, path: Column) -> Column:
    """The URL as a parser writes it back: lower-case scheme (https when missing), escaped path."""
    after_scheme = F.regexp_replace(url, rf"^{_SCHEME}", "")
    fragment = F.regexp_extract(url, r"#([\s\S]*)$", 1)
    authority = F.concat(F.lit("//"), authority_of(url))
    marked_query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    rebuilt = F.concat(
        F.when(after_scheme.startswith("//"), authority).otherwise(""),
        F.when(path.rlike(_PLAIN_PATH), path).otherwise(_escape(decoded_path(path), keep_query_mark=False)),
        marked_query,
        F.when(fragment == "", "")
        .when(fragment.rlike(_PLAIN_FRAGMENT), F.concat(F.lit("#"), fragment))
        .otherwise(F.concat(F.lit("#"), _escape(decoded_path(fragment), keep_query_mark=True))),
    )
    return F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit(":"), rebuilt)


def _escape(decoded: Column, keep_query_mark: bool) -> Column:
    """Percent-encode, leaving the marks a path (or a fragment) may hold unescaped."""
    out = F.url_encode(decoded)
    marks = [
        ("*", "%2A"), ("+", "%20"), ("%2F", "/"), ("%24", "$"), ("%26", "&"), ("%2B", "+"),
        ("%2C", ","), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@"), ("%7E", "~"),
    ]
    if keep_query_mark:
        marks += [("%3F", "?"), ("%21", "!"), ("%28", "("), ("%29", ")"), ("%2A", "*")]
    for encoded, plain in marks:
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out


def decoded_query_values(query: Column) -> Column:
    """Array of decoded, lower-cased query values; pairs with ``;`` or a bad escape are dropped."""
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.contains(";") & ~p.rlike(_BAD_ESCAPE))
    return F.transform(pairs, lambda p: F.lower(F.try_url_decode(F.regexp_extract(p, r"^[^=]*=([\s\S]*)$", 1))))


def ipv4_octets(host: Column) -> Column:
    """Array of four ints for dotted-quad text without leading zeros, else NULL."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(
        host.rlike(rf"^{octet}(?:\.{octet}){{3}}$"),
        F.transform(F.split(host, r"\."), lambda x: x.cast("int")),
    )
