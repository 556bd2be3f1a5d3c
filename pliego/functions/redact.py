"""Log redaction and formatting: FN17-FN25.

Each function reproduces the reference's sanitiser on one string column,
including the places where it leaks (kept for parity, SURVEY §7.6).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col, is_empty

EMPTY = "[empty]"


def sanitize_path(path) -> Column:
    """FN17: last path element; trailing '/' ignored; null/empty -> '[empty]'.

    ``Paths.get(p).getFileName()`` drops trailing and repeated '/'; the root
    alone has no file name and falls back to the text after the last '/' or
    backslash, which is ''.
    """
    p = col(path)
    trimmed = F.regexp_replace(p, "/+$", "")
    name = F.regexp_extract(trimmed, "([^/]*)$", 1)
    return F.when(is_empty(p), F.lit(EMPTY)).otherwise(name)


def file_name_of(path) -> Column:
    """FN24: strip a ``scheme://****/`` mask, then the text after the last '/'
    unless that '/' is the last char (then the whole text).

    Written as two regex rewrites so the input is referenced once per
    branch: nesting sanitisers must not multiply the expression size.
    """
    p = col(path)
    clean = F.regexp_replace(p, r"(?s)^(?:s3|https?)://\*{4}.", "")
    name = F.regexp_replace(clean, r"(?s)^.*/(?=[^/]+$)", "")
    return F.when(is_empty(p), F.lit(EMPTY)).otherwise(name)


def _uri_path(u: Column) -> Column:
    """java.net.URI#getPath: decoded path, NULL when the URI does not parse."""
    raw = F.try_parse_url(u, F.lit("PATH"))
    return F.when(raw.isNotNull(), F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))


def _uri_parses(u: Column) -> Column:
    return F.try_parse_url(u, F.lit("PROTOCOL")).isNotNull() | F.try_parse_url(u, F.lit("PATH")).isNotNull()


def sanitize_s3_uri(uri) -> Column:
    """FN19: ``s3://b/k/f`` -> ``s3://****/f``; ``s3@h:k/f`` -> ``f``; else the name."""
    u = col(uri)
    i = F.locate(":", u)
    s3_scheme = F.concat(F.lit("s3://****/"), file_name_of(_uri_path(u)))
    return (
        F.when(is_empty(u), F.lit(EMPTY))
        .when(u.startswith("s3://") & _uri_parses(u), s3_scheme)
        .when(u.startswith("s3://"), file_name_of(u))
        .when(u.contains("@") & (i > 0), file_name_of(F.substr(u, i + 1)))
        .otherwise(file_name_of(u))
    )


def sanitize_http_url(url) -> Column:
    """FN20: ``<scheme>://****/<name>``; query and fragment dropped; a URL that
    does not parse gives the bare name."""
    u = col(url)
    scheme = F.coalesce(F.try_parse_url(u, F.lit("PROTOCOL")), F.lit("http"))
    masked = F.concat(scheme, F.lit("://****/"), file_name_of(_uri_path(u)))
    return (
        F.when(is_empty(u), F.lit(EMPTY))
        .when(_uri_parses(u), masked)
        .otherwise(file_name_of(u))
    )


def sanitize_template_path(path) -> Column:
    """FN18: dispatch on the form of the template path."""
    p = col(path)
    return (
        F.when(is_empty(p), F.lit(EMPTY))
        .when(p.startswith("s3://") | p.startswith("s3@"), file_name_of(sanitize_s3_uri(p)))
        .when(p.startswith("http://") | p.startswith("https://"), file_name_of(sanitize_http_url(p)))
        .otherwise(sanitize_path(p))
    )


def sanitize_map(m) -> Column:
    """FN21: 'null' / '{empty}' / '{n fields}' (distinct keys, as a Java map)."""
    c = col(m)
    n = F.size(F.array_distinct(F.map_keys(c)))
    return (
        F.when(c.isNull(), F.lit("null"))
        .when(n == 0, F.lit("{empty}"))
        .otherwise(F.format_string("{%d fields}", n))
    )


def human_bytes(n) -> Column:
    """FN22: '<n> B', '%.1f KB' or '%.1f MB' (Java rounding: half up)."""
    b = col(n).cast("bigint")
    return (
        F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B")))
        .when(b < 1024 * 1024, F.format_string("%.1f KB", b.cast("double") / F.lit(1024.0)))
        .otherwise(F.format_string("%.1f MB", b.cast("double") / F.lit(1024.0 * 1024.0)))
    )


def sanitize_bucket(bucket) -> Column:
    """FN23: never show a bucket name."""
    return F.when(is_empty(col(bucket)), F.lit(EMPTY)).otherwise(F.lit("[S3_BUCKET]"))


# The three redaction patterns, applied in this order.
PATH_PATTERN = r"/[\w/.-]+/"
URL_PATTERN = r"https?://[^\s]+"
IPV4_PATTERN = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"


def sanitize_error_message(message) -> Column:
    """FN25: paths -> '/.../', URLs -> 'http://[REDACTED]', IPv4 -> '[IP]'."""
    m = col(message)
    s = F.regexp_replace(m, PATH_PATTERN, "/.../")
    s = F.regexp_replace(s, URL_PATTERN, "http://[REDACTED]")
    s = F.regexp_replace(s, IPV4_PATTERN, "[IP]")
    return F.when(m.isNull(), F.lit("null")).otherwise(s)
