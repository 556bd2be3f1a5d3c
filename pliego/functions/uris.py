"""Template URI functions: FN3-FN9, FN27, FN29 and the path check of V4.

Template URIs look like ``s3@host:key``, ``fs@/abs/path``, ``http@https://...``
or a bare relative path (packaged template).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col, first_index, is_blank, last_index, substring_from, substring_to

# The protocol prefixes with a template source, in lookup order,
# and the name each source reports ('http' stands for http@ and https@).
PROTOCOLS = [("s3@", "s3@"), ("fs@", "fs@"), ("http@", "http"), ("https@", "http")]


def has_protocol(uri) -> Column:
    """FN3: contains '@'; null -> false."""
    return F.coalesce(col(uri).contains("@"), F.lit(False))


def is_local(uri) -> Column:
    """FN4: non-blank and without '@'."""
    u = col(uri)
    return ~is_blank(u) & ~has_protocol(u)


def template_protocol(uri) -> Column:
    """FN5 / J6: name of the first source whose prefix matches, else NULL."""
    u = col(uri)
    expr = None
    for prefix, name in PROTOCOLS:
        cond = u.startswith(prefix)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr


def parse_s3_uri(uri) -> Column:
    """FN6: ``s3@host:key`` -> struct<host, key, ok>; no colon -> ok=false."""
    u = col(uri)
    rest = F.substr(u, F.lit(4))
    i = first_index(rest, ":")
    ok = u.startswith("s3@") & (i >= 0)
    return F.struct(
        F.when(ok, substring_to(rest, i)).alias("host"),
        F.when(ok, substring_from(rest, i + 1)).alias("key"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
    )


def strip_protocol(uri) -> Column:
    """FN7: drop ``fs@`` / ``http@`` / ``https@``."""
    u = col(uri)
    return (
        F.when(u.startswith("fs@"), F.substr(u, F.lit(4)))
        .when(u.startswith("http@"), F.substr(u, F.lit(6)))
        .when(u.startswith("https@"), F.substr(u, F.lit(7)))
        .otherwise(u)
    )


def path_after_colon(uri) -> Column:
    """FN8: text after the first ':'; none or trailing -> unchanged; blank -> ''."""
    u = col(uri)
    i = first_index(u, ":")
    return (
        F.when(is_blank(u), F.lit(""))
        .when((i >= 0) & (i < F.length(u) - 1), substring_from(u, i + 1))
        .otherwise(u)
    )


def cache_key(uri) -> Column:
    """FN9: md5 hex of the URI + its extension (last dot after the last '/')."""
    u = col(uri)
    return F.concat(F.md5(u), F.regexp_extract(u, r"(\.[^./]*)$", 1))


def safe_name_fallback(uri) -> Column:
    """FN29: every char outside [a-zA-Z0-9._-] becomes '_'."""
    return F.regexp_replace(col(uri), r"[^a-zA-Z0-9._-]", "_")


def template_file_name(path) -> Column:
    """FN27: short template name for logs; '[unknown]' when empty."""
    p = col(path)
    i = first_index(p, ":")
    bare = F.when(p.contains("@") & (i >= 0) & (i < F.length(p) - 1), substring_from(p, i + 1)).otherwise(p)
    s = F.greatest(last_index(bare, "/"), last_index(bare, "\\"))
    name = F.when((s >= 0) & (s < F.length(bare) - 1), substring_from(bare, s + 1)).otherwise(bare)
    return F.when(p.isNull() | (p == ""), F.lit("[unknown]")).otherwise(name)


def path_is_unsafe(path) -> Column:
    """V4 predicate: True when the template path would be rejected.

    Blank -> rejected. With a protocol ('@') only '..' is banned; without one
    also a leading '/' or '\\' and a drive letter ``X:``.
    """
    p = col(path)
    no_proto = ~p.contains("@")
    # String.matches("^[a-zA-Z]:.*") -- '.' stops at line terminators.
    drive = p.rlike(r"^[a-zA-Z]:[^\n\r\u0085\u2028\u2029]*$")
    bad = p.contains("..") | (no_proto & (p.startswith("/") | p.startswith("\\") | drive))
    return is_blank(p) | F.coalesce(bad, F.lit(False))


def path_error_subject(path) -> Column:
    """Text put into the E5 message: the path, or 'null or empty'."""
    p = col(path)
    return F.when(is_blank(p), F.lit("null or empty")).otherwise(p)
