"""SO6: bring in the remote templates that a batch names, one round at a time.

A round takes the distinct protocol URIs of the requests (J3), leaves out those
with a fresh landed copy (ST3) and fetches the others by path in tasks. A URI
that isn't there is a row with its E6 text, not a failed job; it is no copy, so
the next round tries it again. Rows go to the landed table in one append, under
the hour of their fetch: older hours than the TTL's are pruned when it is read,
however many rounds it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors as E
from ..functions.uris import path_is_unsafe
from ..operators.lookup import CACHE_TTL_SECONDS, evict_expired, requested_templates
from .templates import lookup_keys, missing_cause
from .topic import open_store

LANDED_DDL = "uri string, source string, key string, content string, fetched_at timestamp, error string, hour string"
# Files that one fetching task reads before it hands them on.
BATCH_FILES = 32


def _at(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def _hour(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd-HH")


def landed(spark: SparkSession, table: str) -> DataFrame:
    """The landed table as it stands; empty before the first round."""
    from pyarrow import fs

    store, base = open_store(table)
    there = store.get_file_info(base).type == fs.FileType.Directory
    if not there:
        return spark.createDataFrame([], LANDED_DDL)
    return spark.read.schema(LANDED_DDL).parquet(table)


def fresh_templates(spark: SparkSession, table: str, as_of, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """The template table (source, key, content, fetched_at, uri) of the copies
    that are fresh at ``as_of``, the latest of each URI. Only hours within the
    TTL are read."""
    at = _at(as_of)
    rows = landed(spark, table).where(F.col("hour").between(_hour(at - F.make_dt_interval(secs=F.lit(ttl_seconds))), _hour(at)))
    rows = evict_expired(rows.where(F.col("error").isNull() & (F.col("fetched_at") <= at)), at, "fetched_at", ttl_seconds)
    last = F.max_by(F.struct("source", "key", "content", "fetched_at"), "fetched_at")
    return rows.groupBy("uri").agg(last.alias("t")).select("t.*", "uri")


def fetch(wanted: DataFrame, roots: dict[str, str]) -> DataFrame:
    """``wanted`` (uri, source, key, failure) with content, or the cause why there
    is none (empty: nothing is there). A file is opened by the task that has its URI."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        stores = {source: open_store(root) for source, root in roots.items()}

        def one(source, key, failure):
            if failure is not None or source not in stores:
                return None, failure or f"No landed root for {source}"
            store, base = stores[source]
            try:
                with store.open_input_stream(f"{base}/{key.lstrip('/')}") as f:
                    return f.read().decode("utf-8", "replace"), None
            except FileNotFoundError:
                return None, ""
            except OSError as err:  # no file, no access
                return None, f"{type(err).__name__}: {key}"

        for b in batches:
            for part in (b.slice(i, BATCH_FILES) for i in range(0, b.num_rows, BATCH_FILES)):
                found = [one(*row) for row in zip(*(part.column(c).to_pylist() for c in ("source", "key", "failure")), strict=True)]
                cols = [pa.array([v[i] for v in found], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("uri", "source", "key")), *cols], names=["uri", "source", "key", "content", "cause"])

    return wanted.select("uri", "source", "key", "failure").mapInArrow(run, "uri string, source string, key string, content string, cause string")


def land_requested(requests: DataFrame, table: str, roots: dict[str, str], as_of, uri: str = "template_path",
                   ttl_seconds: int = CACHE_TTL_SECONDS, tasks: int | None = None) -> None:
    """One round over the template URIs of ``requests``, at ``as_of``. Local paths
    and blank URIs need no landing; an unsafe path is never opened."""
    spark = requests.sparkSession
    at = _at(as_of)
    asked = requested_templates(requests, uri).select("uri")
    needed = asked.join(fresh_templates(spark, table, at, ttl_seconds).select("uri"), "uri", "left_anti")
    keys, failure = lookup_keys(F.col("uri"))
    unsafe = F.when(path_is_unsafe("uri"), F.format_string(E.E5_INVALID_PATH, F.col("uri")))
    wanted = needed.select("uri", keys[0]["source"].alias("source"), keys[0]["key"].alias("key"), F.coalesce(unsafe, failure).alias("failure"))
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = fetch(wanted.repartition(tasks, "uri"), roots)
    cause = F.when(F.col("cause") == "", missing_cause(F.col("uri"))).otherwise(F.col("cause"))
    error = F.when(cause.isNotNull(), F.format_string(E.E6_NOT_FOUND, F.format_string(E.E6_DOWNLOAD_FAILED, cause)))
    rows = found.select("uri", "source", "key", "content", at.alias("fetched_at"), error.alias("error"), _hour(at).alias("hour"))
    rows.write.mode("append").partitionBy("hour").parquet(table)
