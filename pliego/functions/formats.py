"""Formats and content types: FN1, FN2, FN16 (and RN9 routing)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col, java_trim, last_index, substring_from

# The three document formats, their extension and MIME type.
FORMATS = {"pdf": "application/pdf", "html": "text/html", "txt": "text/plain"}

# Store content types by file extension (lower case).
CONTENT_TYPES = [
    ("pdf", "application/pdf"),
    ("html", "text/html"),
    ("htm", "text/html"),
    ("txt", "text/plain"),
    ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("odt", "application/vnd.oasis.opendocument.text"),
    ("doc", "application/msword"),
]
OCTET_STREAM = "application/octet-stream"


def resolve_format(file_type) -> Column:
    """FN1 / RN9: null, blank or unknown -> 'pdf'; trims and ignores case."""
    known = F.create_map(*[F.lit(x) for f in FORMATS for x in (f, f)])  # looked up, so that the text is trimmed once
    return F.coalesce(F.try_element_at(known, F.lower(java_trim(col(file_type)))), F.lit("pdf"))


def format_mime(fmt) -> Column:
    """FN2: MIME type of a resolved format."""
    f = col(fmt)
    expr = None
    for k, v in FORMATS.items():
        expr = F.when(f == k, v) if expr is None else expr.when(f == k, v)
    return expr


def format_extension(fmt) -> Column:
    """FN2: file extension of a resolved format (same text as the format)."""
    f = col(fmt)
    return F.when(f.isin(*FORMATS), f)


def file_extension(name) -> Column:
    """FN14: text after the last dot, if the dot is neither first nor last."""
    n = col(name)
    i = last_index(n, ".")
    return F.when((i > 0) & (i < F.length(n) - 1), substring_from(n, i + 1)).otherwise(F.lit(""))


def file_extension_simple(path) -> Column:
    """FN15: text after the last dot if that dot is not at 0 (may span '/')."""
    p = col(path)
    i = last_index(p, ".")
    return F.when(i > 0, substring_from(p, i + 1)).otherwise(F.lit(""))


def content_type(name) -> Column:
    """FN16: store content type from the file name extension, case-insensitive."""
    ext = F.lower(file_extension(name))
    expr = None
    for k, v in CONTENT_TYPES:
        expr = F.when(ext == k, v) if expr is None else expr.when(ext == k, v)
    return expr.otherwise(F.lit(OCTET_STREAM))
