"""ST1 run the pipeline per micro-batch; ST4 delivery; ST5 ordering.

Each micro-batch of Kafka records is decoded (SO3), run through the batch
pipeline (RN11) and written with ``foreachBatch``: results, documents, their
catalog, responses, failures, error strings and a summary. All are staged and
become visible with one commit (``sinks.ledger``): a batch that fails between two
writes leaves nothing to be seen, and one that comes again after its commit (a
restart from the checkpoint) is left alone. Record positions (``offset``) are
kept as columns: order is data, not an accident of execution.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.pipeline import generate_documents
from ..session import configure, ensure_checkpoint_dir
from ..sinks.ledger import Attempt, committed, is_committed
from ..sinks.ports import save
from ..sinks.responses import batch_errors, failures, responses
from ..sinks.store import document_catalog, stage_catalog, with_object_keys
from ..sources.kafka import decode_record


@dataclass
class StreamOutputs:
    root: str
    prefix: str = "documentos"
    bucket: str = "documentos"

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def attempt(self, spark: SparkSession, batch_id: int) -> Attempt:
        return Attempt(spark, self.root, batch_id)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """An output of all committed batches."""
        return committed(spark, self.root, name)


def process_batch(batch: DataFrame, batch_id: int, templates: Callable[[], DataFrame], out: StreamOutputs) -> None:
    """ST1 body: one micro-batch end to end (failures isolated per record).

    The batch's clock is its latest record time, so a replay names the same
    files; templates are listed anew for each batch. Results are written once;
    responses (SK4), failures (SK5) and errors (A1) come from the written rows,
    documents (SK1) and catalog (SK6) from a second pass over the decoded records.
    The summary (A1) is counted within the job that writes the results.
    """
    spark = batch.sparkSession
    configure(spark)
    if is_committed(spark, out.root, batch_id):
        return
    begin = time.monotonic()
    rec = decode_record(batch).withColumn("msg_id", F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")))
    rec = rec.persist()
    try:
        clock = rec.agg(F.max("timestamp")).first()[0]
        if clock is None:  # no records
            return
        as_of = F.timestamp_millis(F.lit(clock))
        g = generate_documents(rec.where("decode_ok").select("msg_id", "raw"), templates(), as_of)

        attempt = out.attempt(spark, batch_id)
        status = g.messages.select("msg_id", "ok", "error_code", "error_message", "documents", "pending", "response")
        bad = rec.where(~F.col("decode_ok")).select(
            "msg_id", F.lit(False).alias("ok"), F.lit("E11").alias("error_code"), F.col("decode_error").alias("error_message"),
            F.lit(0).cast("bigint").alias("documents"), F.lit(0).cast("bigint").alias("pending"), F.lit(None).cast("string").alias("response"),
        )
        keys = rec.select("msg_id", "topic", "partition", "offset")
        seen = Observation(f"batch-{attempt.id}")
        counts = [F.count(F.lit(1)).alias("processed"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failure")]
        done = attempt.stage(status.unionByName(bad).join(keys, "msg_id").observe(seen, *counts), "results")
        docs = with_object_keys(g.documents.where(F.col("status") == "rendered"), as_of, out.prefix, out.bucket)
        stored = attempt.stage(docs.select("msg_id", "output_pos", "comp_pos", "format", "location", "object_key", "repository_path", "body"), "documents")
        save(stored, batch_id, attempt.id)
        stage_catalog(attempt, document_catalog(docs, as_of))
        attempt.stage(responses(done, key="msg_id"), "responses")
        attempt.stage(failures(done), "failures")
        attempt.stage(batch_errors(done), "errors")
        n = seen.get
        ms = int((time.monotonic() - begin) * 1000)
        one = spark.range(1).select(*[F.lit(n[c]).cast("bigint").alias(c) for c in ("processed", "success", "failure")],
                                    F.lit(ms).cast("bigint").alias("duration_ms"), F.current_timestamp().alias("timestamp"), as_of.alias("as_of"))
        attempt.stage(one, "summary")
        attempt.commit()
    finally:
        rec.unpersist()


def run_stream(records: DataFrame, templates: Callable[[], DataFrame], out_root: str, checkpoint: str | None = None,
               available_now: bool = True, interval: str = "5 seconds"):
    """ST1: start the streaming query; ``records`` is a streaming DataFrame
    with the Kafka record columns (SO4), ``templates`` lists the template table."""
    spark = records.sparkSession
    ckpt = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "stream-" + os.path.basename(out_root.rstrip("/")))
    out = StreamOutputs(out_root)
    w = records.writeStream.option("checkpointLocation", ckpt).foreachBatch(lambda df, bid: process_batch(df, bid, templates, out))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def land_records(records: DataFrame, path: str, batch_col: str = "batch_id") -> None:
    """Write records as JSON-lines files, one folder per Kafka batch, for the
    offline file stream source (SO4 without the Kafka connector)."""
    records.write.mode("overwrite").partitionBy(batch_col).json(path)
