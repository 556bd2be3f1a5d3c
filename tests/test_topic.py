"""SO4: a topic of segments as a stream with offsets; SO3 on odd bytes."""

import datetime
import os
import shutil

import pytest
from pyspark.errors import StreamingQueryException

from pliego.sources.kafka import decode_record
from pliego.sources.topic import SCHEMA, admit, land_segments, read_topic, segments


def records(spark, parts, start, end):
    at = datetime.datetime(2024, 1, 1)
    rows = [(None if o % 5 == 0 else b"k%d" % o, b'{"n":%d}' % o, "t", p, o, at, 0, None) for p in parts for o in range(start, end)]
    return spark.createDataFrame(rows, SCHEMA)


def run(spark, tmp_path, batches=None, **options):
    """Run the query until it has read all there is, or for a number of batches."""
    rows = read_topic(spark, str(tmp_path / "topic"), str(tmp_path / "ckpt"), options)
    sizes = []

    def take(df, batch_id):
        if batches is not None and len(sizes) >= batches:
            raise RuntimeError("enough")
        df.withColumn("batch", df["offset"] * 0 + batch_id).write.mode("append").parquet(str(tmp_path / "out"))
        sizes.append(df.count())

    q = rows.writeStream.option("checkpointLocation", str(tmp_path / "ckpt")).foreachBatch(take).start()
    try:
        q.processAllAvailable()
    except StreamingQueryException:
        assert batches is not None
    finally:
        q.stop()
    return sizes


def read(spark, tmp_path):
    return sorted((r["partition"], r["offset"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_restart_amid_the_topic(spark, tmp_path):
    """Batches keep their bound, before and after a failed batch and a restart; each record comes once."""
    land_segments(records(spark, [0, 1, 2], 0, 100), str(tmp_path / "topic"), width=30)
    assert len(segments(str(tmp_path / "topic"))[("t", "0")]) == 4
    first = run(spark, tmp_path, batches=2, startingOffsets="earliest", maxOffsetsPerTrigger="70")
    land_segments(records(spark, [0, 3], 100, 150), str(tmp_path / "topic"), width=30)
    rest = run(spark, tmp_path, startingOffsets="earliest", maxOffsetsPerTrigger="70")
    assert len(first) == 2 and all(0 < n <= 70 for n in first + rest)
    assert read(spark, tmp_path) == sorted([(p, o) for p in range(3) for o in range(100)] + [(p, o) for p in (0, 3) for o in range(100, 150)])


def test_latest_and_given_offsets(spark, tmp_path):
    topic = str(tmp_path / "topic")
    land_segments(records(spark, [0, 1], 0, 40), topic, width=30)
    assert sum(run(spark, tmp_path, startingOffsets="latest")) == 0
    land_segments(records(spark, [0], 40, 45), topic, width=30)
    assert run(spark, tmp_path, startingOffsets="latest") == [5]
    os.makedirs(tmp_path / "b")
    shutil.copytree(topic, tmp_path / "b" / "topic")
    run(spark, tmp_path / "b", startingOffsets='{"t": {"0": 43, "1": -2}}')
    assert read(spark, tmp_path / "b") == [(0, 43), (0, 44)] + [(1, o) for o in range(40)]


def test_a_missing_segment_fails_the_query(spark, tmp_path):
    whole = str(tmp_path / "whole")
    land_segments(records(spark, [0], 0, 90), whole, width=30)
    found = segments(whole)[("t", "0")]
    os.makedirs(tmp_path / "topic" / "topic=t" / "partition=0")
    for _, _, path in (found[0], found[2]):
        shutil.copy(path, tmp_path / "topic" / "topic=t" / "partition=0")
    rows = read_topic(spark, str(tmp_path / "topic"), str(tmp_path / "ckpt"), {"startingOffsets": "earliest"})
    q = rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ckpt")).start()
    with pytest.raises(StreamingQueryException, match="Offsets 30 to 59 of topic t, partition 0 are gone"):
        q.processAllAvailable()
    q.stop()
    assert run(spark, tmp_path, startingOffsets="earliest", failOnDataLoss="false") == [60]


def test_admission_by_backlog():
    end = {"t": {"0": 1000, "1": 10, "2": 0}, "u": {"0": 90}}
    got = admit({"t": {"0": 0, "1": 0, "2": 0}}, end, 110, {"u": {"0": 0}})
    taken = [got["t"]["0"], got["t"]["1"], got["u"]["0"]]
    assert sum(taken) <= 110 and taken[0] >= 90 and taken[1] >= 1 and taken[2] >= 9
    assert admit({}, end, None, {}) == end and admit({"t": {"0": 900}}, end, 1000, {"t": {"1": 0, "2": 0}, "u": {"0": 0}}) == end


def test_odd_bytes_are_replaced(spark):
    rows = [(b"\xff{", 1), (b'{"a":"\xc3("}', 2), (b'{"a":"\xf0\x9f\x98"}', 3), (None, 4), ('{"a":"ñ"}'.encode(), 5)]
    df = spark.createDataFrame([("t", 0, o, "k", v) for v, o in rows], "topic string, partition int, offset long, key string, value binary")
    got = {r.offset: (r.raw, r.decode_ok) for r in decode_record(df).collect()}
    assert got == {1: ("�{", False), 2: ('{"a":"�("}', True), 3: ('{"a":"�"}', True), 4: (None, False), 5: ('{"a":"ñ"}', True)}


def test_a_broken_template_is_read_with_replacements(spark, tmp_path):
    from pliego.sources.templates import read_templates

    (tmp_path / "a.html").write_bytes("caf\xe9 {{x}}".encode("latin-1"))
    (tmp_path / "b.html").write_bytes("bien".encode())
    got = {r.key: r.content for r in read_templates(spark, str(tmp_path)).collect()}
    assert got == {"templates/a.html": "caf� {{x}}", "templates/b.html": "bien"}
