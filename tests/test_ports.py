"""U3: a user's own store takes part in a batch."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pliego.plans import fixtures
from pliego.plans.queries import templates
from pliego.sinks import ports
from pliego.sinks.ledger import ledger
from pliego.streaming.stream import StreamOutputs, process_batch

SF = "/root/testdata/sf0.001"


def folder_store():
    """A store of JSON files: tasks write half files, the commit renames them."""

    class Written(WriterCommitMessage):
        def __init__(self, half):
            self.half = half

    class Writer(DataSourceWriter):
        def __init__(self, options):
            self.options = options

        def write(self, iterator):
            from pyspark import TaskContext

            half = f"{self.options['path']}/_{self.options['attempt']}-{TaskContext.get().partitionId()}"
            with open(half, "w") as f:
                for row in iterator:
                    if row.body == "broken":
                        raise OSError("store is full")
                    f.write(json.dumps({"msg_id": row.msg_id, "body": row.body}) + "\n")
            return Written(half)

        def commit(self, messages):
            for i, m in enumerate(messages):
                os.replace(m.half, f"{self.options['path']}/{self.options['batch_id']}-{i}.json")

        def abort(self, messages):
            with open(f"{self.options['path']}/_aborted", "a") as f:
                f.write(self.options["attempt"] + "\n")

    class FolderStore(DataSource):
        @classmethod
        def name(cls):
            return "folder_store"

        def writer(self, schema, overwrite):
            return Writer(self.options)

    return FolderStore


@pytest.fixture
def store(tmp_path):
    path = str(tmp_path / "store")
    os.makedirs(path)
    ports.register_document_store("folder", folder_store(), {"path": path})
    yield path
    ports.unregister_document_store("folder")


def stored(path):
    return [json.loads(line) for n in os.listdir(path) if n.endswith(".json") for line in open(f"{path}/{n}")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_a_batch_saves_to_the_registered_store(spark, tmp_path, store):
    recs = fixtures.kafka_records(spark, SF).where("offset < 100").drop("batch_id", "topic_name")
    out = StreamOutputs(str(tmp_path / "out"))
    for _ in range(2):
        process_batch(recs, 3, lambda: templates(spark), out)
    want = {r.msg_id: r.body for r in out.read(spark, "documents").collect()}
    rows = stored(store)
    assert len(rows) == len(want) > 0 and {r["msg_id"]: r["body"] for r in rows} == want


def test_a_failed_task_aborts_once(spark, tmp_path, store):
    docs = spark.range(40).select(F.col("id").cast("string").alias("msg_id"), F.when(F.col("id") == 39, "broken").otherwise("fine").alias("body"))
    with pytest.raises(Exception, match="store is full"):
        ports.save(docs.repartition(4, "msg_id"), 1, "first")
    assert stored(store) == [] and open(f"{store}/_aborted").read() == "first\n"
    ports.save(docs.where("msg_id <> '39'"), 1, "second", ["folder"])
    assert sorted(int(r["msg_id"]) for r in stored(store)) == list(range(39)) and open(f"{store}/_aborted").read() == "first\n"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_a_store_that_fails_keeps_the_batch_unseen(spark, tmp_path, store, monkeypatch):
    recs = fixtures.kafka_records(spark, SF).where("offset < 50").drop("batch_id", "topic_name")
    out = StreamOutputs(str(tmp_path / "out"))
    monkeypatch.setitem(ports.DOCUMENT_STORES, "folder", (ports.DOCUMENT_STORES["folder"][0], {"path": store + "/absent"}))
    with pytest.raises(Exception):
        process_batch(recs, 0, lambda: templates(spark), out)
    assert ledger(spark, out.root).count() == 0
    monkeypatch.setitem(ports.DOCUMENT_STORES, "folder", (ports.DOCUMENT_STORES["folder"][0], {"path": store}))
    process_batch(recs, 0, lambda: templates(spark), out)
    assert len(stored(store)) == out.read(spark, "documents").count() > 0
