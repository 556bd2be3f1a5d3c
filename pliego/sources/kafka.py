"""Kafka batches and records: SO2 explode, SO3 decode, SO4 stream source.

A failed decode or parse never fails the batch: it becomes an error row with
the reference's ``Record Topic %s, Key %s, Offset %d: <cause>`` text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .. import errors as E
from ..schema import KAFKA_RECORD_DDL

# Cause texts for the two envelope failures (ours).
CAUSE_BASE64 = "Illegal base64 character in record value"
CAUSE_JSON = "Unrecognized token: record value is not a JSON object"


def explode_kafka_batch(batches: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """SO2: ``records`` map -> one row per record, map order then list order;
    ``record_pos`` is the encounter position inside the batch."""
    keep = keep or ["batch_id"]
    tp = batches.select(*keep, F.posexplode(F.map_entries("records")).alias("tp_pos", "tp"))
    r = tp.select(*keep, "tp_pos", F.col("tp.key").alias("tp_key"), F.posexplode("tp.value").alias("rec_pos", "rec"))
    return r.select(*keep, "tp_pos", "rec_pos", "tp_key", "rec.*")


def record_count(records) -> Column:
    """A2: total number of records in a batch envelope."""
    r = F.col(records) if isinstance(records, str) else records
    return F.aggregate(F.map_values(r), F.lit(0).cast("bigint"), lambda acc, x: acc + F.size(x))


def decode_value(value) -> Column:
    """Base64 -> text; NULL where java.util.Base64's basic decoder fails."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(~v.rlike(r"\s"), utf8_text(F.try_to_binary(v, F.lit("base64"))))


def utf8_text(value: Column) -> Column:
    """Bytes as UTF-8 text, U+FFFD in place of what is none: odd bytes never raise."""
    return F.make_valid_utf8(value.cast("string"))


def decode_record(records: DataFrame) -> DataFrame:
    """SO3: adds ``raw`` (the message JSON), ``decode_ok`` and
    ``decode_error`` (E11 text) to exploded records. A text ``value`` is
    base64, as in a batch envelope; a binary one is the record's bytes."""
    binary = isinstance(records.schema["value"].dataType, BinaryType)
    text = utf8_text(F.col("value")) if binary else decode_value("value")
    parsed = F.from_json(text, "metadata string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    looks_like_object = F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))
    cause = (
        F.when(text.isNull(), F.lit(CAUSE_BASE64))
        .when(~looks_like_object | parsed["_corrupt"].isNotNull(), F.lit(CAUSE_JSON))
    )
    err = F.when(
        cause.isNotNull(),
        F.format_string(E.E11_RECORD, F.col("topic"), F.coalesce(F.col("key"), F.lit("null")), F.col("offset"), cause),
    )
    return records.select("*", text.alias("raw"), err.alias("decode_error")).withColumn(
        "decode_ok", F.col("decode_error").isNull()
    )


def kafka_rows(raw: DataFrame) -> DataFrame:
    """Rows of the Kafka source as records: the value stays binary, time stamps
    keep their type, headers are kept."""
    kind = F.when(F.col("timestampType") == 0, F.lit("CREATE_TIME")).when(F.col("timestampType") == 1, F.lit("LOG_APPEND_TIME"))
    return raw.select(
        "topic", "partition", "offset",
        F.unix_millis("timestamp").alias("timestamp"),
        kind.alias("timestampType"),
        utf8_text(F.col("key")).alias("key"),
        "value",
        *(["headers"] if "headers" in raw.columns else []),
    )


def read_kafka_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """SO4: the request topic as a stream from the latest offsets; lost offsets
    fail the query, headers come along. ``options`` add to or replace these; set
    ``maxOffsetsPerTrigger`` to bound a batch (the reference takes 10 records).
    Needs the Kafka connector on the classpath; without it ``topic.read_topic``
    reads landed segments with the same rows, offsets and options."""
    opts = {"startingOffsets": "latest", "failOnDataLoss": "true", "includeHeaders": "true"}
    opts.update(options)
    return kafka_rows(spark.readStream.format("kafka").options(**opts).load())


def read_record_files(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """SO4 offline: a file stream of landed records with the Kafka record
    schema (JSON lines)."""
    ddl = KAFKA_RECORD_DDL[len("struct<"):-1].replace(":", " ")
    return spark.readStream.schema(ddl + ", batch_id bigint").option("maxFilesPerTrigger", max_files_per_trigger).json(path)
