"""Kafka envelope (FIXTURES F3): explode, decode, E11 for bad records."""

import base64
import json

from pyspark.sql import functions as F

from pliego.schema import KAFKA_BATCH_DDL
from pliego.sources.kafka import decode_record, explode_kafka_batch, record_count


def test_sample_batch(spark):
    flat = {"templatePath": "plantilla.docx", "data": {"codigo": "1", "nombre": "X"}}
    v = base64.b64encode(json.dumps(flat).encode()).decode()
    rec = lambda off, key, val: {"topic": "t", "partition": 0, "offset": off, "timestamp": 1, "timestampType": "CREATE_TIME",
                                 "key": key, "value": val, "headers": []}
    batch = {"eventSource": "aws:kafka", "records": {"t-0": [rec(123, "request-001", v), rec(124, "request-002", v),
                                                             rec(125, "request-003", "not base64!!")]}}
    df = spark.createDataFrame([(json.dumps(batch),)], "j string").select(F.from_json("j", KAFKA_BATCH_DDL).alias("b"))
    df = df.select(F.lit(1).alias("batch_id"), "b.records")
    assert df.select(record_count("records")).first()[0] == 3
    rows = decode_record(explode_kafka_batch(df)).orderBy("offset").collect()
    assert [r["offset"] for r in rows] == [123, 124, 125]
    assert [r["decode_ok"] for r in rows] == [True, True, False]
    assert rows[2]["decode_error"].startswith("Record Topic t, Key request-003, Offset 125: ")
