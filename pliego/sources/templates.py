"""Template sources: SO5 packaged templates, SO6 landed copies of remote ones.

The template table is ``source STRING, key STRING, content STRING,
fetched_at TIMESTAMP``: ``source`` is ``packaged`` or the protocol prefix of
the template source (``s3@``, ``fs@``, ``http``) and ``key`` what that source
is addressed by (package path, object key, absolute path, host + path).
Each root is one recursive ``binaryFile`` scan: cost grows with the number
of template files, never with the number of requests.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors as E
from ..functions.redact import sanitize_path
from ..functions.uris import parse_s3_uri, strip_protocol, template_protocol
from .kafka import utf8_text

PACKAGED = "packaged"
PACKAGE_PREFIX = "templates/"
FILESYSTEM = "file"


def _scan(spark: SparkSession, root: str) -> DataFrame:
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    root_norm = root.rstrip("/") + "/"
    rel = F.substr(F.col("path"), F.locate(root_norm, F.col("path")) + F.lit(len(root_norm)))
    return df.select(
        rel.alias("rel"),
        utf8_text(F.col("content")).alias("content"),  # one broken file must not end the scan of all
        F.col("modificationTime").alias("fetched_at"),
    )


def read_templates(spark: SparkSession, root: str) -> DataFrame:
    """SO5: packaged templates; ``root`` is the package folder, keys are
    ``templates/<relative path>`` like a classpath resource."""
    return _scan(spark, root).select(
        F.lit(PACKAGED).alias("source"),
        F.concat(F.lit(PACKAGE_PREFIX), F.col("rel")).alias("key"),
        "content",
        "fetched_at",
    )


def read_filesystem_templates(spark: SparkSession, root: str) -> DataFrame:
    """SO5: templates that a local path may name outside the package; keys are
    paths below ``root``, the working folder of the reference."""
    return _scan(spark, root).select(F.lit(FILESYSTEM).alias("source"), F.col("rel").alias("key"), "content", "fetched_at")


def land_templates(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """SO6: landed copies of remote templates, one root per protocol:
    ``{"s3@": <templates bucket path>, "fs@": <mount>, "http": <mirror>}``.

    * ``s3@``: the object key under the configured bucket (host ignored);
    * ``fs@``: the absolute path, re-rooted under the mount;
    * ``http``: ``host/path`` of the URL under the mirror.
    """
    parts = []
    for source, root in roots.items():
        df = _scan(spark, root)
        key = F.concat(F.lit("/"), F.col("rel")) if source == "fs@" else F.col("rel")
        parts.append(df.select(F.lit(source).alias("source"), key.alias("key"), "content", "fetched_at"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# U2: extra template sources by protocol name; each is a callable
# ``spark -> DataFrame(source, key, content, fetched_at)``.
TEMPLATE_SOURCES: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register_template_source(protocol: str, fn: Callable[[SparkSession], DataFrame]) -> None:
    """U2: plug a template source (e.g. a mirrored HTTP store) under a
    protocol name; its rows join the template table."""
    TEMPLATE_SOURCES[protocol] = fn


def template_table(spark: SparkSession, packaged_root: str, landed_roots: dict[str, str], filesystem_root: str | None = None) -> DataFrame:
    out = read_templates(spark, packaged_root).unionByName(land_templates(spark, landed_roots))
    if filesystem_root:
        out = out.unionByName(read_filesystem_templates(spark, filesystem_root))
    for fn in TEMPLATE_SOURCES.values():
        out = out.unionByName(fn(spark).select("source", "key", "content", "fetched_at"))
    return out


def missing_cause(uri: Column) -> Column:
    """Why a protocol URI could not be downloaded where nothing is there, in the reference's wording."""
    return (
        F.when(uri.startswith("fs@"), F.concat(F.lit("Source file not found: "), sanitize_path(F.substr(uri, F.lit(4)))))
        .when(uri.startswith("s3@"), F.concat(F.lit("The specified key does not exist. "), uri))
        .otherwise(F.concat(F.lit("HTTP error: 404 for URL: "), uri))
    )


def _key(source: Column, key: Column) -> Column:
    return F.struct(source.alias("source"), key.alias("key"))


def lookup_keys(uri: Column, fmt: Column | None = None, key: Callable[[Column, Column], Column] = _key) -> tuple[list[Column], Column]:
    """(keys in the order they are tried, failure text) of a template URI.

    Keys are struct<source, key>, or what ``key`` makes of the two, NULL where there is none. A local path tries
    the package folder, then the package root (not for PDF, ``fmt``), then the
    filesystem. A protocol URI has a single key; an unknown protocol or a
    malformed S3 URI has none and carries the failure text the reference's
    download step produces.
    """
    proto = template_protocol(uri)
    s3 = parse_s3_uri(uri)
    stripped = strip_protocol(uri)
    http_key = F.regexp_replace(stripped, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    local = ~uri.contains("@")

    primary = (
        F.when(local, key(F.lit(PACKAGED), F.concat(F.lit(PACKAGE_PREFIX), uri)))
        .when((proto == "s3@") & s3["ok"], key(F.lit("s3@"), s3["key"]))
        .when(proto == "fs@", key(F.lit("fs@"), stripped))
        .when(proto == "http", key(F.lit("http"), http_key))
    )
    in_root = local if fmt is None else local & (fmt != "pdf")
    keys = [primary, F.when(in_root, key(F.lit(PACKAGED), uri)), F.when(local, key(F.lit(FILESYSTEM), uri))]
    failure = (
        F.when(local, F.lit(None).cast("string"))
        .when(proto.isNull(), F.format_string(E.E6_NO_DOWNLOADER, uri))
        .when((proto == "s3@") & ~s3["ok"], F.concat(F.lit("Invalid S3 URI format: "), uri))
    )
    return keys, failure
