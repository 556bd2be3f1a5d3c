"""SK3/SK4 responses to the reply topic, SK5 dead letters, SK7 producer
settings.

Responses are ``to_json`` values written with the Kafka sink when the
connector is present, else as JSON files with the same ``key``/``value``
columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Producer settings of the reference (SK7), as Kafka sink options.
PRODUCER_OPTIONS = {
    "kafka.acks": "all",
    "kafka.retries": "3",
    "kafka.max.in.flight.requests.per.connection": "1",
    "kafka.compression.type": "gzip",
    "kafka.batch.size": "16384",
    "kafka.linger.ms": "10",
    "kafka.buffer.memory": str(64 * 1024 * 1024),
    "kafka.max.request.size": str(10 * 1024 * 1024),
}
RESPONSE_TOPIC = "document-responses"


def responses(messages: DataFrame, key: str | None = None) -> DataFrame:
    """SK3 (unkeyed) / SK4 (keyed): ``key, value`` rows of successful messages."""
    ok = messages.where(F.col("ok"))
    k = F.col(key).cast("string") if key else F.lit(None).cast("string")
    return ok.select(k.alias("key"), F.col("response").alias("value"))


def write_responses(messages: DataFrame, path: str | None = None, key: str | None = None,
                    kafka_options: dict[str, str] | None = None) -> None:
    """SK3/SK4: to the reply topic (Kafka) or, offline, to JSON files."""
    out = responses(messages, key)
    if kafka_options is not None:
        opts = dict(PRODUCER_OPTIONS, topic=RESPONSE_TOPIC)
        opts.update(kafka_options)
        out.write.format("kafka").options(**opts).save()
    else:
        out.write.mode("append").json(path)


def failures(messages: DataFrame) -> DataFrame:
    """SK5: failed messages with their error (the dead-letter rows)."""
    return messages.where(~F.col("ok")).select("msg_id", "error_code", "error_message")


def batch_errors(messages: DataFrame) -> DataFrame:
    """A1's ``errors``: a row per failed record with its place in the batch and the
    error string. Rows, not one list, so that a batch may be of any size."""
    return messages.where(~F.col("ok")).select("topic", "partition", "offset", F.col("error_message").alias("error"))
