"""Template lookups and the template cache rules (ST2/ST3).

J1 is a left join of requests to the template table. The template side is
broadcast only after measuring it (row count and content bytes); above the
limit the join is left to a shuffle join, where AQE splits a hot URI.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.uris import cache_key, is_local, template_protocol
from ..sources.templates import lookup_keys

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
CACHE_TTL_SECONDS = 2 * 3600


def measured_broadcast(df: DataFrame, limit_bytes: int = BROADCAST_LIMIT_BYTES, payload: str | None = None) -> DataFrame:
    """``broadcast(df)`` if its measured size is under ``limit_bytes``, else
    ``df`` unchanged (shuffle join). The measure is one aggregate job."""
    size_expr = F.count(F.lit(1)) * F.lit(64)
    if payload:
        size_expr = size_expr + F.coalesce(F.sum(F.octet_length(payload)), F.lit(0))
    size = df.agg(size_expr.alias("b")).first()["b"]
    return F.broadcast(df) if size <= limit_bytes else df


def resolve_templates(requests: DataFrame, templates: DataFrame, uri: str = "template_path", fmt: str = "format",
                      limit_bytes: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """J1: adds ``template_found`` (bool), ``template_content``,
    ``template_fetched_at`` and ``template_failure`` (download failure text).

    A local path tries its places in order (``lookup_keys``).
    """
    keys, failure = lookup_keys(F.col(uri), F.col(fmt))
    t = measured_broadcast(templates.select("source", "key", "content", "fetched_at"), limit_bytes, "content")
    df = requests.withColumn("template_failure", failure)
    for i, k in enumerate(keys):
        # Keys of sources without a template cannot match and stay NULL: a request joins one or two places.
        df = df.withColumn(f"_k{i}", k)
        place = t.select(F.struct("source", "key").alias(f"_k{i}"), F.struct("content", "fetched_at").alias(f"_t{i}"))
        df = df.join(place, f"_k{i}", "left")
    first = F.coalesce(*[F.col(f"_t{i}") for i in range(len(keys))])
    return df.select(
        *[c for c in requests.columns],
        first.isNotNull().alias("template_found"),
        first["content"].alias("template_content"),
        first["fetched_at"].alias("template_fetched_at"),
        "template_failure",
    )


def missing_templates(requests: DataFrame, templates: DataFrame, uri: str = "template_path", fmt: str = "format") -> DataFrame:
    """J2 / V6 report form: requests whose template resolves nowhere (anti join)."""
    keys, _ = lookup_keys(F.col(uri), F.col(fmt))
    known = templates.select(F.struct("source", "key").alias("_k"))
    df = requests
    for i, k in enumerate(keys):
        df = df.withColumn(f"_k{i}", k).join(known.withColumnRenamed("_k", f"_k{i}"), f"_k{i}", "left_anti")
    return df.drop(*[f"_k{i}" for i in range(len(keys))])


def requested_templates(requests: DataFrame, uri: str = "template_path") -> DataFrame:
    """J3: the distinct protocol URIs a batch needs landed (with their key)."""
    u = F.col(uri)
    return (
        requests.where(~is_local(u) & u.isNotNull() & (F.trim(u) != ""))
        .select(u.alias("uri"))
        .distinct()
        .select("uri", template_protocol("uri").alias("protocol"), cache_key("uri").alias("cache_key"))
    )


def evict_expired(cache: DataFrame, as_of, ts: str = "fetched_at", ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """ST3: keep cache entries younger than the TTL at ``as_of``."""
    as_of_c = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    return cache.where(F.unix_micros(F.col(ts)) > F.unix_micros(as_of_c) - F.lit(ttl_seconds * 1_000_000))


def fresh_cache_lookup(requests: DataFrame, cache: DataFrame, key: str = "uri", ts: str = "ts",
                       ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """J5 (as-of lookup): for each request, the latest cache entry of its URI
    fetched at or before the request and less than ``ttl`` before it. Adds
    ``entry_at`` (NULL = miss).

    Requests and entries are one stream of rows, cut into slices of a TTL's
    64th. Inside a slice the last entry at or before a request is a running
    maximum; before it, only the last entries of the 64 slices before can
    serve, of which the latest is a running maximum over one row a slice. Work
    is linear in the rows, and a hot URI is as many groups as it has slices.
    """
    slice_us = max(1, ttl_seconds * 1_000_000 // 64)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    r = requests.select(F.col(key).alias("_k"), us(ts).alias("_t"), F.struct(*requests.columns).alias("_row"))
    c = cache.select(F.col(key).alias("_k"), us("fetched_at").alias("_t"), F.lit(None).cast(r.schema["_row"].dataType).alias("_row"))
    rows = c.unionByName(r).withColumn("_s", F.floor(F.col("_t") / slice_us))
    entry = F.when(F.col("_row").isNull(), F.col("_t"))
    # Range frame: entries of the same microsecond count for a request.
    inside = Window.partitionBy("_k", "_s").orderBy("_t")
    rows = rows.withColumn("_in", F.max(entry).over(inside)).where(F.col("_row").isNotNull())
    last = c.withColumn("_s", F.floor(F.col("_t") / slice_us)).groupBy("_k", "_s").agg(F.max("_t").alias("_last"))
    slices = rows.select("_k", "_s").distinct().withColumn("_last", F.lit(None).cast("long")).unionByName(last)
    slices = slices.groupBy("_k", "_s").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col("_k").alias("_sk"), F.col("_s").alias("_ss"), F.max("_last").over(before).alias("_before"))
    joined = rows.join(slices, F.col("_k").eqNullSafe(F.col("_sk")) & (F.col("_s") == F.col("_ss")), "left")
    found = F.coalesce("_in", "_before")
    fresh = F.when(F.col("_t") - found < ttl_seconds * 1_000_000, F.timestamp_micros(found))
    return joined.select("_row.*", fresh.alias("entry_at"))
