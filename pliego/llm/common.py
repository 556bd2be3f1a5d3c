"""Helpers shared by the training-data operators: table reads, cutting lineage
through the shared folder, row keys and gapless numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# White space as the contracts define it: \x20 and \x09-\x0D.
BLANKS = "\t\n\x0b\x0c\r "
# Rows of text handed to one Python call; texts may be long, so batches stay short.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Only a
    local master (tests, a laptop) may do without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="pliego-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    The plan starts anew from replicated files: what follows neither recomputes
    nor loses it when an executor goes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of an Arrow batch, so that a batch of very long texts fits in memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` and the nullable fields of ``ddl``."""
    return StructType([*df.schema, *StructType.fromDDL(ddl)])


def row_key(*cols: str) -> list[Column]:
    """Two 64-bit hashes of the named columns: one key for rows equal in all of
    them, nulls included. Repeated rows share a key and so a decision."""
    return [F.xxhash64(*cols).alias("_k1"), F.xxhash64(F.lit("again"), *reversed(cols)).alias("_k2")]


KEY = ["_k1", "_k2"]


def whole_row() -> Column:
    """All columns of a row as ``_row``, so that working columns beside it can't clash."""
    return F.struct("*").alias("_row")


def gapless(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group 0, 1, 2 ... in column ``name``.

    A group is cut into salts by a hash of ``order`` and numbered salt by salt,
    so no group is sorted in one task; a prefix sum over the small table of
    salt counts gives each salt its first number. There may be few groups only,
    as many as a parameter of the caller says: their sizes are broadcast. ``df``
    must be read from files (it is scanned again) and ``order`` should tell rows
    apart: rows equal in it take any order among themselves.
    """
    sizes = cut(df.groupBy(group).agg(F.count(F.lit(1)).alias("_size")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    per_salt = min(65536, max(256, total // 1000))
    salt = F.pmod(F.xxhash64(*order, F.lit(7)), F.ceil(F.col("_size") / per_salt).cast("long"))
    salted = df.join(F.broadcast(sizes), group).withColumn("_salt", salt).drop("_size")
    counts = salted.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = cut(counts.select(group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")), "salts")
    within = Window.partitionBy(group, "_salt").orderBy(*order)
    numbered = salted.withColumn("_i", F.row_number().over(within) - 1)
    return numbered.join(first, [group, "_salt"]).withColumn(name, (F.col("_first") + F.col("_i")).cast("long")).drop("_salt", "_first", "_i")
