"""Embedded images: MIME sniffing, data URIs (RN2) and payload checks (V5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col, let

# Leading bytes (hex) -> MIME, tested in this order; webp also
# needs at least 4 decoded bytes. Anything else, or a head that does not
# decode, is PNG.
MAGIC = [("8950", "image/png", 2), ("FFD8", "image/jpeg", 2), ("4749", "image/gif", 2), ("5249", "image/webp", 4)]
DEFAULT_MIME = "image/png"


def strict_base64(value) -> Column:
    """Decoded bytes, or NULL where java.util.Base64's basic decoder rejects
    the text (any whitespace, a bad character, a lone trailing char)."""
    v = col(value)
    return F.when(~v.rlike(r"\s"), F.try_to_binary(v, F.lit("base64")))


def sniff_image_mime(b64) -> Column:
    """RN2: MIME type from the first 20 base64 chars."""
    def mime(head: Column) -> Column:
        h = F.hex(head)
        expr = None
        for magic, mime, min_len in MAGIC:
            cond = (F.octet_length(head) >= min_len) & h.startswith(magic)
            expr = F.when(cond, mime) if expr is None else expr.when(cond, mime)
        return F.coalesce(expr, F.lit(DEFAULT_MIME))

    # Decoded once, though each magic number looks at it.
    return let(strict_base64(F.substr(col(b64), F.lit(1), F.lit(20))), mime)


def image_data_uri(b64) -> Column:
    """RN2: ``data:<mime>;base64,<payload>``; a NULL payload gives the bare
    PNG placeholder."""
    v = col(b64)
    return F.when(v.isNull(), F.lit("data:image/png;base64,")).otherwise(
        F.concat(F.lit("data:"), sniff_image_mime(v), F.lit(";base64,"), v)
    )


def bad_image_payload(images) -> Column:
    """V5 (PDF path): True if any image value does not decode strictly."""
    m = col(images)
    return F.coalesce(F.exists(F.map_values(m), lambda x: x.isNull() | strict_base64(x).isNull()), F.lit(False))
