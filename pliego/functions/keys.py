"""Identifiers, file names, object keys and summaries: FN10-FN13, FN26, FN28.

The reference draws a random ULID / UUID and the wall clock; here the clock
is an ``as_of`` column and randomness a hash of a key column, so a rerun of
the same batch writes the same names (idempotent sinks, SURVEY §7.1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col, last_index, substring_from, substring_to

# Spark's base-32 digits and Crockford's base-32 alphabet.
BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _b32(value: Column, base: int, width: int) -> Column:
    """A number's text in ``base`` as ``width`` of Crockford's digits."""
    return F.translate(F.lpad(F.conv(value, base, 32), width, "0"), BASE32_DIGITS, CROCKFORD)


def sortable_id(ts, key) -> Column:
    """FN10: 26-char ULID-shaped id: 10 chars of epoch millis, 16 of md5(key)."""
    ms = F.unix_millis(col(ts).cast("timestamp"))
    h = F.md5(col(key).cast("string"))
    hi, lo = F.substr(h, F.lit(1), F.lit(10)), F.substr(h, F.lit(11), F.lit(10))
    return F.concat(_b32(ms.cast("string"), 10, 10), _b32(hi, 16, 8), _b32(lo, 16, 8))


def document_filename(doc_id, file_type) -> Column:
    """FN11: ``<id>.<fileType>`` with the raw file type (null prints 'null')."""
    return F.concat(col(doc_id), F.lit("."), F.coalesce(col(file_type), F.lit("null")))


def local_location(path) -> Column:
    """FN12: ``fs@`` + path."""
    return F.concat(F.lit("fs@"), col(path))


def object_key(prefix, ts, file_name, uid) -> Column:
    """FN13: ``prefix/yyyy/MM/dd/base-uid.ext``; a dot at 0 is no extension."""
    f = col(file_name)
    i = last_index(f, ".")
    base = F.when(i > 0, substring_to(f, i)).otherwise(f)
    ext = F.when(i > 0, substring_from(f, i)).otherwise(F.lit(""))
    t = col(ts)
    return F.concat_ws(
        "/",
        col(prefix),
        F.date_format(t, "yyyy"),
        F.date_format(t, "MM"),
        F.date_format(t, "dd"),
        F.concat(base, F.lit("-"), col(uid), ext),
    )


def object_location(bucket, key) -> Column:
    """FN13: ``s3@:bucket/key`` (':' = the configured bucket)."""
    return F.concat(F.lit("s3@:"), col(bucket), F.lit("/"), col(key))


def _key_set(m: Column) -> Column:
    return F.when(m.isNull(), F.lit("null")).otherwise(
        F.concat(F.lit("["), F.array_join(F.array_distinct(F.map_keys(m)), ", "), F.lit("]"))
    )


def request_summary(path, data, images, persist) -> Column:
    """FN26: path and key sets only, never values."""
    return F.concat(
        F.lit("TemplateRequest{templatePath='"),
        F.coalesce(col(path), F.lit("null")),
        F.lit("', dataKeys="),
        _key_set(col(data)),
        F.lit(", imageKeys="),
        _key_set(col(images)),
        F.lit(", isPersist="),
        F.when(col(persist), F.lit("true")).otherwise(F.lit("false")),
        F.lit("}"),
    )


def cache_age(created, now) -> Column:
    """FN28: ``%dh %dm`` of ``now - created`` (truncated like Duration)."""
    d = F.unix_micros(col(now).cast("timestamp")) - F.unix_micros(col(created).cast("timestamp"))
    hours = (d / F.lit(3_600_000_000)).cast("bigint")
    minutes = (d / F.lit(60_000_000)).cast("bigint") % F.lit(60)
    return F.format_string("%dh %dm", hours, minutes)
