"""Registered queries: one per operator of SURVEY §2, each reading the
provided tables (or data Spark derives from them) end to end.

Every query returns flat columns aliased exactly as in ``plans/oracle.py``.
"""

from __future__ import annotations

import os
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors as E
from .. import functions as fn
from ..operators import lookup, reshape
from ..operators.collate import check_result_counts
from ..operators.jsontext import as_map
from ..operators.render import html_context, render_report, rendered, rendered_size, route_format
from ..schema import REQUEST_KEY
from ..session import configure
from ..sinks.responses import failures
from ..sources.kafka import decode_record, explode_kafka_batch, kafka_rows, record_count
from ..sources.messages import parse_messages
from ..sources.tables import table
from ..sources.templates import template_table
from . import fixtures
from .pipeline import Generation, generate_documents

AS_OF = "2024-02-01 00:00:00"
RESOURCES = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "resources")
PACKAGED_ROOT = os.path.join(RESOURCES, "templates")
LANDED_ROOTS = {
    "s3@": os.path.join(RESOURCES, "landed", "s3"),
    "fs@": os.path.join(RESOURCES, "landed", "fs"),
    "http": os.path.join(RESOURCES, "landed", "http"),
}
DOCS_BUCKET = "documentos-generados"
DOCS_PREFIX = "documentos"

_GEN: dict[tuple[str, str], Generation] = {}


def ts_text(c):
    """Timestamps leave queries as text so engines compare them exactly."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def templates(spark: SparkSession) -> DataFrame:
    return template_table(spark, PACKAGED_ROOT, LANDED_ROOTS)


def generation(spark: SparkSession, sf: str) -> Generation:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _GEN:
        configure(spark)
        _GEN[key] = generate_documents(fixtures.messages(spark, sf), templates(spark), AS_OF)
    return _GEN[key]


def _generated_once(spark: SparkSession, sf: str, name: str) -> Generation:
    """The generation of a query that reads both its messages and its documents: the
    messages are built, parsed, checked and answered once for the two."""
    configure(spark)
    return generate_documents(fixtures.messages(spark, sf), templates(spark), AS_OF, kept=_scratch(spark, name))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    return parse_messages(fixtures.messages(spark, sf))


def all_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Template compositions of every parsed message (no validation)."""
    return reshape.only_templates(reshape.flatten_outputs(parsed(spark, sf)))


# ---------------------------------------------------------- functions ----

def _uri_query(col_fns: dict[str, Callable]) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, sf: str) -> DataFrame:
        u = fixtures.uris(spark, sf)
        return u.select("page_id", "variant", "uri", *[f(F.col("uri")).alias(n) for n, f in col_fns.items()])
    return q


def q_fn06(spark, sf):
    u = fixtures.uris(spark, sf)
    p = fn.parse_s3_uri(F.col("uri"))
    return u.select("page_id", "variant", "uri", p["host"].alias("host"), p["key"].alias("key"), p["ok"].alias("ok"))


def q_v4(spark, sf):
    u = fixtures.uris(spark, sf)
    bad = fn.path_is_unsafe(F.col("uri"))
    return u.select(
        "page_id", "variant", "uri", bad.alias("unsafe"),
        F.when(bad, F.format_string(E.E5_INVALID_PATH, fn.path_error_subject(F.col("uri")))).alias("error_message"),
    )


def q_v7(spark, sf):
    u = fixtures.uris(spark, sf)
    bad = fn.has_protocol(F.col("uri")) & fn.template_protocol(F.col("uri")).isNull()
    msg = F.format_string(E.E6_NOT_FOUND, F.format_string(E.E6_DOWNLOAD_FAILED, F.format_string(E.E6_NO_DOWNLOADER, F.col("uri"))))
    return u.select("page_id", "variant", "uri", F.when(bad, msg).alias("error_message"))


def _lines(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    fmt = fixtures._pick(fixtures.FORMAT_CYCLE, F.pmod(F.col("l_partkey"), F.lit(len(fixtures.FORMAT_CYCLE))))
    return li.withColumn("raw_format", fmt)


def q_fn01(spark, sf):
    li = _lines(spark, sf)
    f = route_format(F.col("raw_format"))
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "raw_format",
        f.alias("format"), fn.format_mime(f).alias("mime"), fn.format_extension(f).alias("extension"),
    )


def _events(spark, sf):
    ev = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type")
    fmt = fixtures._pick(fixtures.FORMAT_CYCLE, F.pmod(F.col("event_id"), F.lit(len(fixtures.FORMAT_CYCLE))))
    doc_id = fn.sortable_id(F.col("ts"), F.col("event_id").cast("string"))
    return ev.select("event_id", F.col("ts").cast("timestamp").alias("ts"), fmt.alias("raw_format"), doc_id.alias("doc_id"))


def q_fn10(spark, sf):
    return _events(spark, sf).select("event_id", "doc_id")


def q_fn11(spark, sf):
    return _events(spark, sf).select("event_id", fn.document_filename(F.col("doc_id"), F.col("raw_format")).alias("file_name"))


def q_fn12(spark, sf):
    e = _events(spark, sf)
    path = F.concat(F.lit("/temp/"), fn.document_filename(F.col("doc_id"), F.col("raw_format")))
    return e.select("event_id", fn.local_location(path).alias("location"))


def q_fn13(spark, sf):
    e = _events(spark, sf)
    name = fn.document_filename(F.col("doc_id"), F.col("raw_format"))
    uid = F.substr(F.md5(F.col("event_id").cast("string")), F.lit(1), F.lit(8))
    key = fn.object_key(F.lit(DOCS_PREFIX), F.col("ts"), name, uid)
    return e.select("event_id", key.alias("object_key"), fn.object_location(F.lit(DOCS_BUCKET), key).alias("location"))


def q_fn28(spark, sf):
    e = _events(spark, sf)
    return e.select("event_id", fn.cache_age(F.col("ts"), F.lit(AS_OF).cast("timestamp")).alias("age"))


def _query_map(spark, sf):
    p = table(spark, sf, "pages", "page_id", "url")
    q = F.regexp_extract("url", r"\?([^#]*)", 1)
    m = F.when(F.col("url").contains("?"), F.str_to_map(q, F.lit("&"), F.lit("=")))
    return p.select("page_id", m.alias("m"))


def q_fn21(spark, sf):
    configure(spark)
    return _query_map(spark, sf).select("page_id", fn.sanitize_map(F.col("m")).alias("fields"))


def q_fn22(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "n_chars")
    p = table(spark, sf, "pages", "page_id", "html")
    sizes = d.select(
        F.col("doc_id").alias("id"),
        F.posexplode(F.array(F.col("n_chars"), F.col("n_chars") * 1024, F.col("n_chars") * 1000 + 7)).alias("variant", "n"),
    ).unionByName(p.select(F.col("page_id").alias("id"), F.lit(3).alias("variant"), F.octet_length("html").cast("bigint").alias("n")))
    return sizes.select("id", F.col("variant").cast("bigint").alias("variant"), "n", fn.human_bytes(F.col("n")).alias("text"))


def q_fn23(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "source", "lang")
    b = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("source"))
    return d.select("doc_id", fn.sanitize_bucket(b).alias("bucket"))


def error_texts(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text", "source")
    p = table(spark, sf, "pages", "page_id", "url")
    j = d.join(p, d.doc_id == p.page_id, "left")
    return j.select(
        "doc_id",
        F.concat_ws(" ", F.lit("Error leyendo /var/data/"), F.col("source"), F.lit("/archivo.txt:"), F.col("text"), F.col("url")).alias("text"),
    )


def q_fn25(spark, sf):
    return error_texts(spark, sf).select("doc_id", fn.sanitize_error_message(F.col("text")).alias("message"))


def q_fn26(spark, sf):
    r = reshape.project_request(generation_requests(spark, sf))
    return r.select(*REQUEST_KEY, fn.request_summary("template_path", as_map(F.col("data")), "images", "persist").alias("summary"))


def generation_requests(spark, sf):
    v = generation_validated(spark, sf)
    return reshape.only_templates(reshape.flatten_outputs(v.where(F.col("map_error").isNull())))


def generation_validated(spark, sf):
    from ..operators.validate import validate_messages
    return validate_messages(parsed(spark, sf))


# ----------------------------------------------------------- messages ----

def q_so1(spark, sf):
    p = parsed(spark, sf)
    return p.select("msg_id", "parsed_ok", "has_item", F.coalesce(F.size("outputs"), F.lit(0)).cast("bigint").alias("outputs"))


def q_rs1(spark, sf):
    r = reshape.flatten_outputs(parsed(spark, sf))
    return r.select(
        "msg_id", F.col("output_pos").cast("bigint").alias("output_pos"), F.col("comp_pos").cast("bigint").alias("comp_pos"),
        "output_type", "comp_type", "location", "output_format",
    )


def _key(df):
    return [F.col("msg_id"), F.col("output_pos").cast("bigint").alias("output_pos"), F.col("comp_pos").cast("bigint").alias("comp_pos")]


def q_rs2(spark, sf):
    r = all_requests(spark, sf)
    return r.select(*_key(r), "location", "output_format")


def q_rs3(spark, sf):
    r = reshape.project_request(all_requests(spark, sf))
    return r.select(*_key(r), "template_path", "file_type", F.col("data").isNotNull().alias("has_data"), "persist")


def q_rs4(spark, sf):
    r = reshape.project_request(all_requests(spark, sf))
    return r.select(*_key(r), F.size("images").cast("bigint").alias("n_images"), F.try_element_at("images", F.lit("logo")).alias("logo"))


def q_rs5(spark, sf):
    r = reshape.request_profile(reshape.project_request(all_requests(spark, sf)))
    return r.select(*_key(r), "template_name", "file_type", "data_fields", "has_images", "persist")


def q_v1(spark, sf):
    from ..operators.validate import check_structure
    p = parsed(spark, sf)
    e = check_structure(F.col("parsed_ok"), F.col("has_item"), F.col("outputs"))
    return p.select("msg_id", e["code"].alias("error_code"), e["message"].alias("error_message"))


def q_v2(spark, sf):
    from ..operators.validate import check_composition
    p = parsed(spark, sf)
    o = p.select("msg_id", F.posexplode("outputs").alias("output_pos", "o"))
    e = check_composition(F.col("o"))
    return o.where(e.isNotNull()).select("msg_id", F.col("output_pos").cast("bigint").alias("output_pos"), e["message"].alias("error_message"))


def q_v3(spark, sf):
    from ..operators.validate import composition_error
    r = all_requests(spark, sf)
    e = composition_error(F.struct(
        F.col("comp_type").alias("type"), F.col("output_format"), F.col("location"), F.col("data"), F.col("has_resource"), F.col("data_is_object"),
    ))
    return r.select(*_key(r), e["code"].alias("error_code"), e["message"].alias("error_message"))


def q_v5(spark, sf):
    from ..operators.render import pdf_images_error
    r = reshape.project_request(all_requests(spark, sf))
    e = pdf_images_error("images")
    return r.select(*_key(r), e["code"].alias("error_code"))


def _status(spark, sf):
    return generation(spark, sf).messages


def q_v9(spark, sf):
    return _status(spark, sf).select("msg_id", "ok", "error_code", "error_message")


def q_v10(spark, sf):
    s = _status(spark, sf).where(~F.col("ok"))
    c = E.classify_error(F.col("error_code"), F.col("error_message"))
    return s.select("msg_id", c["error"].alias("error"), c["message"].alias("message"), c["status"].cast("bigint").alias("status"))


def q_sk5(spark, sf):
    return failures(_status(spark, sf))


def q_a1(spark, sf):
    s = _status(spark, sf)
    return s.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("ok")).alias("success"),
        F.count_if(~F.col("ok")).alias("failure"),
    )


def q_a3(spark, sf):
    return q_so1(spark, sf).select("msg_id", "outputs")


def q_a4(spark, sf):
    r = all_requests(spark, sf)
    return r.groupBy("msg_id").agg(F.count(F.lit(1)).alias("requests"))


def _resolved(spark, sf):
    r = reshape.project_request(all_requests(spark, sf)).withColumn("format", route_format("file_type"))
    return lookup.resolve_templates(r, templates(spark))


def q_j1(spark, sf):
    r = _resolved(spark, sf)
    return r.select(*_key(r), "template_path", "format", "template_found")


def q_j2(spark, sf):
    r = reshape.project_request(all_requests(spark, sf)).withColumn("format", route_format("file_type"))
    m = lookup.missing_templates(r, templates(spark))
    return m.select(*_key(m), "template_path")


def q_j3(spark, sf):
    r = reshape.project_request(all_requests(spark, sf))
    return lookup.requested_templates(r)


def q_a5(spark, sf):
    return q_j3(spark, sf).select("protocol").distinct()


def _docs(spark, sf):
    return generation(spark, sf).documents


def q_rn8(spark, sf):
    d = _docs(spark, sf).where(F.col("format") == "txt")
    return d.select(*_key(d), "template_path", "body")


def q_rn6(spark, sf):
    d = _docs(spark, sf).where(F.col("format") == "html")
    return d.select(*_key(d), "template_path", "body")


def q_rn1(spark, sf):
    d = _docs(spark, sf).where(F.col("format") == "html")
    ctx = html_context("data", "images")
    return d.select(*_key(d), F.array_join(F.map_keys(ctx), ",").alias("context_keys"),
                    F.try_element_at(ctx, F.lit("imagen_logo")).alias("imagen_logo"))


def q_rn2(spark, sf):
    r = reshape.project_request(all_requests(spark, sf))
    img = F.try_element_at("images", F.lit("logo"))
    return r.where(img.isNotNull()).select(*_key(r), fn.sniff_image_mime(img).alias("mime"), fn.image_data_uri(img).alias("data_uri"))


def q_rn10(spark, sf):
    return render_report(_docs(spark, sf))


def q_a6(spark, sf):
    d = _docs(spark, sf)
    return d.groupBy("format", "status").agg(F.count(F.lit(1)).alias("documents"))


def q_a7(spark, sf):
    """A7 as cumulative ``le`` buckets over the sizes of rendered documents."""
    d = _docs(spark, sf).select(rendered_size("body").alias("b"))
    les = [512, 1024, 2048, 4096, 8192]
    row = d.agg(*[F.count_if(F.col("b") <= le).alias(f"le_{le}") for le in les], F.count("b").alias("le_inf"))
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(str(le)).alias("le"), F.col(f"le_{le}").alias("documents")) for le in les
    ], F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("documents")))).alias("h")).select("h.*")


def q_a7_duration(spark, sf):
    """A7 over measured render times, kept once: cumulative buckets, and quantiles
    from sketches per format, merged, against exact ranks. The clock differs from
    run to run, so what is returned is what holds for any clock."""
    from ..operators.render import duration_histogram, duration_quantiles, duration_sketch
    path = os.path.join(_scratch(spark, "a7"), "times")
    _docs(spark, sf).select("format", "render_us").write.parquet(path)
    times = spark.read.parquet(path)
    h = duration_histogram(times).collect()  # a row a bound
    n = h[-1].documents
    rows = [("bucket", r.le, before <= r.documents <= n, n if r.le == "+Inf" else None) for r, before in zip(h, [0, *[r.documents for r in h]])]
    for r in duration_quantiles(duration_sketch(times, ["format"])).collect():  # a row a quantile
        below, upto = times.agg(F.count_if(F.col("render_us") < r.micros), F.count_if(F.col("render_us") <= r.micros)).first()
        rows.append(("quantile", str(r["quantile"]), below / max(n, 1) <= r["quantile"] + 0.02 and upto / max(n, 1) >= r["quantile"] - 0.02, None))
    return spark.createDataFrame(rows, "kind string, name string, holds boolean, documents long")


ECHO_VIEW = (
    "metadata struct<id:string, fecha:string>, data struct<cliente:struct<id:bigint>, item_canonico:struct<output_producto:string, "
    "output_subproducto:string, output_metadata:struct<orden:bigint>, callback:string, outputs:array<struct<type:string, composicion:array<struct<"
    "template:string, type:string, metadata:struct<resource:struct<output_format:string, location:string, data:struct<nombre:string, monto:string, "
    "cantidad:int, items:array<struct<item:string, precio:string>>, cliente:struct<nacion:string>, images:struct<logo:string>>>, "
    "result:struct<location:string>>>>>>>>"
)


def echo_rows(messages: DataFrame, column: str) -> DataFrame:
    """A response's echoed fields, one row per composition of any type."""
    m = messages.select("msg_id", F.from_json(column, ECHO_VIEW).alias("m"))
    head = [
        F.col("m.metadata.id").alias("meta_id"), F.col("m.metadata.fecha").alias("meta_fecha"), F.col("m.data.cliente.id").alias("cliente_id"),
        F.col("m.data.item_canonico.output_producto").alias("producto"), F.col("m.data.item_canonico.output_subproducto").alias("subproducto"),
        F.col("m.data.item_canonico.output_metadata.orden").alias("orden"), F.col("m.data.item_canonico.callback").alias("callback"),
    ]
    o = m.select("msg_id", *head, F.posexplode("m.data.item_canonico.outputs").alias("output_pos", "o"))
    names = ["meta_id", "meta_fecha", "cliente_id", "producto", "subproducto", "orden", "callback"]
    c = o.select("msg_id", *names, "output_pos", F.col("o.type").alias("output_type"), F.posexplode("o.composicion").alias("comp_pos", "c"))
    r = F.col("c.metadata.resource")
    return c.select(
        *_key(c), *names, "output_type", F.col("c.template").alias("template"), F.col("c.type").alias("comp_type"),
        r["output_format"].alias("output_format"), r["location"].alias("template_path"),
        r["data"]["nombre"].alias("nombre"), r["data"]["monto"].alias("monto"), r["data"]["cantidad"].cast("bigint").alias("cantidad"),
        F.get(r["data"]["items"], F.lit(1))["precio"].alias("impuesto"), r["data"]["cliente"]["nacion"].alias("nacion"),
        r["data"]["images"]["logo"].alias("logo"), F.col("c.metadata.result.location").alias("result_location"),
    )


def q_rs10(spark, sf):
    return echo_rows(_status(spark, sf).where(F.col("ok")), "response")


def q_rs13(spark, sf):
    m = fixtures.messages(spark, sf)
    r = reshape.request_from_flat(m)
    return r.where(F.col("template_path").isNotNull()).select("msg_id", "template_path", "is_local")


def q_v8(spark, sf):
    """The requests of successful messages against a batch of results with some
    missing and some twice."""
    made = _scratch(spark, "v8")
    _docs(spark, sf).select(*REQUEST_KEY, "doc_id").write.parquet(made)  # written once, read three times
    d = spark.read.parquet(made)
    order = F.regexp_extract("msg_id", "^m([0-9]+)-", 1).cast("bigint")
    some = d.where(~((order % 7 == 0) & (F.col("comp_pos") == 1)))
    twice = some.where((order % 11 == 0) & (F.col("comp_pos") == 0))
    out = check_result_counts(d, some.unionByName(twice))
    return out.select("msg_id", "templates", "results", F.col("error.code").alias("error_code"), F.col("error.message").alias("error_message"))


def q_rn11(spark, sf):
    """Status of every message with a digest of its documents' names and bodies
    and of its response: the whole pipeline is computed."""
    g = _generated_once(spark, sf, "rn11")
    one = F.struct("output_pos", "comp_pos", F.concat_ws(" ", "location", F.md5("body")).alias("d"))
    docs = g.documents.groupBy("msg_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["d"]), "|")).alias("bodies"))
    locations = F.size(F.regexp_extract_all("response", F.lit('"result":\\{"location":"fs@'), F.lit(0))).cast("bigint")
    m = g.messages.select("msg_id", "ok", "error_code", "documents", "pending", F.when(F.col("ok"), locations).alias("locations"))
    return m.join(docs, "msg_id", "left")


def _stored(spark, sf, name):
    """The catalog of all rendered documents, stored as two batches and compacted."""
    from ..sinks.ledger import Attempt
    from ..sinks.store import compact_catalog, document_catalog, stage_catalog
    root = _scratch(spark, name)
    # Written once: the two batches then read rows instead of rendering every document each.
    document_catalog(_docs(spark, sf).where(F.col("status") == "rendered"), AS_OF).write.parquet(os.path.join(root, "rows"))
    rows = spark.read.parquet(os.path.join(root, "rows"))
    half = F.pmod(F.xxhash64("msg_id"), F.lit(2))
    for batch_id in range(2):
        attempt = Attempt(spark, root, batch_id)
        stage_catalog(attempt, rows.where(half == batch_id))
        attempt.commit()
    compact_catalog(spark, root, 2, [0, 1])
    return root


def q_sk6(spark, sf):
    from ..sinks.store import stored_catalog
    c = stored_catalog(spark, _stored(spark, sf, "sk6"))
    return c.select(*_key(c), "original_filename", "file_size", "generated_date", "file_type", "content_type")


def q_a8(spark, sf):
    from ..sinks.store import catalog_search, stored_catalog
    c = catalog_search(stored_catalog(spark, _stored(spark, sf, "a8")), file_type="txt", generated_date="2024-02-01")
    return c.select(*_key(c), "original_filename", "file_size")


# -------------------------------------------------------------- Kafka ----

def q_so2(spark, sf):
    b = fixtures.kafka_batches(spark, sf)
    r = explode_kafka_batch(b)
    return r.select(
        "batch_id", F.col("tp_pos").cast("bigint").alias("tp_pos"), F.col("rec_pos").cast("bigint").alias("rec_pos"),
        "topic", F.col("partition").cast("bigint").alias("partition"), "offset", "key",
    )


def q_a2(spark, sf):
    b = fixtures.kafka_batches(spark, sf)
    return b.select("batch_id", record_count(F.col("records")).alias("records"))


def q_so3(spark, sf):
    r = decode_record(explode_kafka_batch(fixtures.kafka_batches(spark, sf)))
    return r.select("batch_id", "offset", "decode_ok", "decode_error", "raw")


def q_so3_bytes(spark, sf):
    """Values with bytes that are no UTF-8, once as base64 and once as bytes."""
    rows = fixtures.kafka_byte_rows(spark, sf)
    text = decode_record(rows.withColumn("value", F.base64("value"))).select("topic", "partition", "offset", F.col("raw").alias("from_base64"), F.col("decode_ok").alias("base64_ok"))
    r = decode_record(rows).join(text, ["topic", "partition", "offset"])
    return r.select("topic", F.col("partition").cast("bigint").alias("partition"), "offset", "base64_ok", "from_base64", "decode_ok", "raw")


def q_so4(spark, sf):
    """The Kafka source's own row shape, values binary and longer than a base64 line."""
    r = decode_record(kafka_rows(fixtures.kafka_source_rows(spark, sf)))
    return r.select("topic", F.col("partition").cast("bigint").alias("partition"), "offset", "timestampType", "key", F.size("headers").cast("bigint").alias("headers"), "decode_ok", "decode_error", "raw")


def q_so4_offsets(spark, sf):
    """The topic landed as segments and read as a stream from its earliest
    offsets, a third of them a batch, by a query that is stopped and started again."""
    from ..sources.topic import land_segments, read_topic, segments
    root = _scratch(spark, "so4")
    topic, ckpt, out = (os.path.join(root, n) for n in ("topic", "ckpt", "out"))
    land_segments(fixtures.kafka_source_rows(spark, sf), topic)
    backlog = sum(end - start for found in segments(topic).values() for start, end, _ in found)
    for _ in range(2):
        records = read_topic(spark, topic, ckpt, {"startingOffsets": "earliest", "maxOffsetsPerTrigger": str(backlog // 3 + 1)})
        rows = decode_record(records).select("topic", F.col("partition").cast("bigint").alias("partition"), "offset", "key", "timestamp", "timestampType", "decode_ok", F.md5("value").alias("value"))
        q = rows.writeStream.format("parquet").option("checkpointLocation", ckpt).start(out)
        q.processAllAvailable()
        q.stop()
    return spark.read.schema(rows.schema).parquet(out)


# ----------------------------------------------------- template cache ----

def q_st3(spark, sf):
    """Every request as a cache entry, evicted as of the last one."""
    t = fixtures.template_requests(spark, sf)
    last = t.agg(F.max("ts")).first()[0]
    kept = lookup.evict_expired(t.select("uri", F.col("ts").alias("fetched_at"), "event_id"), last)
    return kept.select("uri", ts_text("fetched_at").alias("fetched_at"), "event_id")


def q_j5(spark, sf):
    t = fixtures.template_requests(spark, sf)
    cache = t.where(F.col("event_type") == "signup").select("uri", F.col("ts").alias("fetched_at"))
    r = lookup.fresh_cache_lookup(t.select("uri", "ts", "event_id"), cache)
    return r.select("event_id", "uri", ts_text("entry_at").alias("entry_at"))


def q_rs6(spark, sf, null_text=""):
    from ..operators.flatten import context_rows
    r = generation(spark, sf).documents.where(F.col("format") == "pdf")
    c = context_rows(r, ["msg_id", "output_pos", "comp_pos"], null_text=null_text)
    return c.select(*_key(c), "name", "value")


def q_rs8(spark, sf):
    return q_rs6(spark, sf, null_text="null")


def _sorted_pairs(m):
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def q_rn7(spark, sf):
    from ..operators.flatten import pdf_context
    d = generation(spark, sf).documents.where(F.col("format") == "pdf")
    d = d.withColumn("p", pdf_context("data", "images"))
    return d.select(*_key(d), _sorted_pairs(F.col("p.context")).alias("context"),
                    F.array_join(F.array_sort(F.map_keys("p.images")), ",").alias("images"),
                    F.base64(F.try_element_at("p.images", F.lit("image_pr_logo"))).alias("logo"))


# ------------------------------------- conversations as nested data ----

def q_rs6_deep(spark, sf):
    from ..operators.flatten import context_rows
    return context_rows(fixtures.nested_data(spark, sf), ["conv_id", "turn"])


def q_rs8_deep(spark, sf):
    from ..operators.flatten import context_rows
    return context_rows(fixtures.nested_data(spark, sf), ["conv_id", "turn"], null_text="null")


def q_rn8_deep(spark, sf):
    d = fixtures.nested_data(spark, sf)
    none = F.create_map().cast("map<string,string>")
    return d.select("conv_id", "turn", rendered(F.lit("txt"), F.lit("orden.html"), F.lit(None).cast("string"), "data", none)["body"].alias("body"))


def q_rn4_kinds(spark, sf):
    """Texts that look like lists, objects or false, bound to sections and variables."""
    d = fixtures.text_kinds(spark, sf)
    none = F.create_map().cast("map<string,string>")
    return d.select("conv_id", "turn", rendered(F.lit("html"), F.lit("x.html"), F.lit(fixtures.KIND_TEMPLATE), "data", none)["body"].alias("body"))


def q_v3_kinds(spark, sf):
    """Data given as an object, as a text that looks like one, as a list or not at all."""
    g = generate_documents(fixtures.data_kinds(spark, sf), templates(spark), AS_OF)
    return g.messages.select("msg_id", "ok", "error_code", "error_message")


def q_rs4_kinds(spark, sf):
    d = fixtures.image_kinds(spark, sf)
    images = reshape.extract_images("data")
    return d.select("conv_id", "turn", F.size(images).cast("bigint").alias("n_images"), F.try_element_at(images, F.lit("logo")).alias("logo"))


def q_rn6_many(spark, sf):
    """One template a page, some malformed, all by the join path."""
    g = generate_documents(fixtures.page_messages(spark, sf), fixtures.page_templates(spark, sf), AS_OF, key_limit=100)
    d = g.documents.select("msg_id", "body")
    return g.messages.select("msg_id", "ok", "error_code", "error_message").join(d, "msg_id", "left")


def _scratch(spark, name):
    """A fresh folder under the session's shared checkpoint folder."""
    import uuid
    from ..session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark), "pliego", f"{name}-{uuid.uuid4().hex[:12]}")


def q_so6(spark, sf):
    """Three rounds over a template per page: some of them, then all an hour
    later on another mount, then all after the first copies have expired."""
    from ..sources.landing import fresh_templates, land_requested, landed
    root = _scratch(spark, "so6")
    mounts = {m: os.path.join(root, m) for m in ("A", "B")}
    fixtures.mount_pages(spark, sf, mounts["A"], "A:", F.col("page_id") % 5 != 0)
    fixtures.mount_pages(spark, sf, mounts["B"], "B:", F.col("page_id") % 10 != 0)
    pages = table(spark, sf, "pages", "page_id").withColumn("template_path", fixtures.page_uri(F.col("page_id")))
    rounds = [("2024-02-01 08:00:00", "A", pages.where(F.col("page_id") % 3 != 0)), ("2024-02-01 09:00:00", "B", pages), ("2024-02-01 10:30:00", "B", pages)]
    store, out = os.path.join(root, "landed"), None
    for at, mount, asked in rounds:
        land_requested(asked, store, {"fs@": mounts[mount]}, at)
        now = landed(spark, store).where(F.col("fetched_at") == F.lit(at).cast("timestamp"))
        got = fresh_templates(spark, store, at).select("uri", "content")
        one = asked.select("page_id", F.col("template_path").alias("uri")).join(got, "uri", "left").join(now.select("uri", "error", F.lit(True).alias("fetched")), "uri", "left")
        one = one.select("page_id", F.lit(at).alias("round"), F.col("fetched").isNotNull().alias("fetched"), "error", F.md5("content").alias("content"))
        out = one if out is None else out.unionByName(one)
    return out


def q_st2(spark, sf):
    from ..streaming.cache_state import fetch_state
    t = fixtures.template_requests(spark, sf)
    r = fetch_state(t.select("uri", "ts"))
    return r.select("uri", ts_text("ts").alias("ts"), "fetched", ts_text("entry_at").alias("entry_at"))


def q_st2_stream(spark, sf):
    """The requests as a stream of files in order of time, one a batch; what the
    watermark hasn't passed at the end is decided from the last state."""
    from ..streaming.cache_state import DECISIONS, LATE, MARKS, STATE, WAITING, fetch_state, run_fetch_state, state_table
    root = _scratch(spark, "st2")
    land, out = os.path.join(root, "in"), os.path.join(root, "out")
    rows = fixtures.template_requests(spark, sf).select("uri", "ts")
    lo, hi = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    for part in range(3):  # files of rising age, so that the file source takes them in order
        place = F.expr(f"(unix_micros(ts) - {lo}) * 3 div {hi - lo + 1}")
        rows.where(place == part).coalesce(1).write.mode("append").parquet(land)
    requests = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(land)
    run_fetch_state(requests, out, os.path.join(root, "ckpt")).awaitTermination()
    read = lambda name: state_table(spark, out, name)
    last = F.col("batch") == read(MARKS).agg(F.max("batch")).first()[0]
    rest = fetch_state(read(WAITING).where(last).select("uri", "ts"), state=read(STATE).where(last))
    late = read(LATE).select("uri", "ts", F.lit(None).cast("boolean").alias("fetched"), F.lit(None).cast("timestamp").alias("entry_at"))
    r = read(DECISIONS).drop("batch").unionByName(rest).unionByName(late)
    return r.select("uri", ts_text("ts").alias("ts"), "fetched", ts_text("entry_at").alias("entry_at"))


def q_st1(spark, sf):
    from ..streaming.stream import StreamOutputs, land_records, run_stream
    from ..sources.kafka import read_record_files
    root = _scratch(spark, "st1")
    recs = fixtures.kafka_records(spark, sf).select(
        "topic", "partition", "offset", "timestamp", "timestampType", "key", "value",
        F.pmod(F.col("batch_id"), F.lit(8)).alias("batch_id"),
    )
    land_records(recs, os.path.join(root, "in"))
    stream = read_record_files(spark, os.path.join(root, "in"), max_files_per_trigger=4)
    q = run_stream(stream, lambda: templates(spark), os.path.join(root, "out"), checkpoint=os.path.join(root, "ckpt"))
    q.awaitTermination()
    out = StreamOutputs(os.path.join(root, "out"))
    read = lambda name: out.read(spark, name)
    docs = read("documents").select("msg_id", F.md5("body").alias("body"))
    sent = read("responses").select(F.col("key").alias("msg_id"), F.lit(True).alias("responded"))
    dead = read("failures").select("msg_id", F.lit(True).alias("failed"))
    total = read("summary").agg(F.sum("processed").alias("processed"), F.sum("success").alias("success"), F.sum("failure").alias("failure")).first()
    res = read("results").join(docs, "msg_id", "left").join(sent, "msg_id", "left").join(dead, "msg_id", "left")
    return res.select("topic", F.col("partition").cast("bigint").alias("partition"), "offset", "ok", "error_code", "body", "responded", "failed",
                      *[F.lit(total[c]).cast("bigint").alias(c) for c in ("processed", "success", "failure")])


def q_st4(spark, sf):
    """Four batches that each fail between two of their writes, come again, and
    come once more after their commit: every row is there once."""
    from ..sinks.ledger import Attempt
    from ..streaming.stream import StreamOutputs, process_batch

    class Broken(Attempt):
        def stage(self, df, name, *args):
            if name == "responses":
                raise OSError("gone between two writes")
            return super().stage(df, name, *args)

    class Failing(StreamOutputs):
        def attempt(self, spark, batch_id):
            return Broken(spark, self.root, batch_id)

    root = _scratch(spark, "st4")
    recs = fixtures.kafka_records(spark, sf)
    for i in range(4):
        batch = recs.where(F.pmod("offset", F.lit(4)) == i).drop("batch_id", "topic_name")
        try:
            process_batch(batch, i, lambda: templates(spark), Failing(root))
        except OSError:
            pass
        for _ in range(2):
            process_batch(batch, i, lambda: templates(spark), StreamOutputs(root))
    out = StreamOutputs(root)
    rows = [out.read(spark, "results").select("batch_id", "msg_id", F.lit("result").alias("kind"))]
    for name, kind, key in (("documents", "document", "msg_id"), ("catalog", "catalog", "msg_id"), ("responses", "response", "key"), ("failures", "failure", "msg_id")):
        rows.append(out.read(spark, name).select("batch_id", F.col(key).alias("msg_id"), F.lit(kind).alias("kind")))
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    return both.groupBy("batch_id", "msg_id", "kind").agg(F.count(F.lit(1)).alias("times"))


def q_a1_batches(spark, sf):
    """A row per Kafka batch of its error strings and counts, from the stream's own summary."""
    from ..streaming.stream import StreamOutputs, process_batch
    root = _scratch(spark, "a1")
    recs = fixtures.kafka_records(spark, sf)
    for i in range(3):
        process_batch(recs.where(F.pmod("batch_id", F.lit(3)) == i).drop("batch_id", "topic_name"), i, lambda: templates(spark), StreamOutputs(root))
    out = StreamOutputs(root)
    s = out.read(spark, "summary").where((F.col("duration_ms") >= 0) & F.col("timestamp").isNotNull())
    errors = out.read(spark, "errors").select("batch_id", "topic", F.col("partition").cast("bigint").alias("partition"), "offset", "error")
    return s.select("batch_id", "processed", "success", "failure").join(errors, "batch_id", "left")


def q_sk1(spark, sf):
    """Every rendered document goes to the store; what waits for a converter has only its local place."""
    from ..sinks.store import write_documents
    root = _scratch(spark, "sk1")
    # Written once: the store and the list of all documents then read the same rows.
    made = _scratch(spark, "sk1_made")
    _docs(spark, sf).select(*REQUEST_KEY, "doc_id", "format", "body", "local_path", "location", "status").write.parquet(made)
    docs = spark.read.parquet(made)
    stored = docs.where(F.col("status") == "rendered")
    back = write_documents(stored, root, AS_OF, prefix=DOCS_PREFIX, bucket=DOCS_BUCKET)
    back = back.select(*REQUEST_KEY, "object_key", "repository_path", F.md5("body").alias("body"))
    out = docs.select(*REQUEST_KEY, "location").join(back, REQUEST_KEY, "left")
    return out.select(*_key(out), "object_key", "repository_path", "body", reshape.pick_location("repository_path", "location").alias("result_location"))


def q_sk2(spark, sf):
    """Every location of a document names a written copy."""
    from ..sinks.store import write_local_copy
    g = _generated_once(spark, sf, "sk2_messages")
    back = write_local_copy(g.documents.where(F.col("status") == "rendered"), _scratch(spark, "sk2"))
    given = reshape.locations_of(g.messages.where(F.col("ok"))).where(F.col("result_location").isNotNull())
    out = given.join(back.select(F.col("location").alias("result_location"), F.md5("body").alias("body")), "result_location", "left")
    return out.select(*_key(out), "result_location", "body")


def _sent(spark, sf, name, key):
    from ..sinks.responses import write_responses
    root = _scratch(spark, name)
    write_responses(_status(spark, sf), root, key=key)
    return spark.read.schema("key string, value string").json(root)


def q_sk3(spark, sf):
    back = _sent(spark, sf, "sk3", None)
    return back.select(F.col("key"), F.get_json_object("value", "$.metadata.id").alias("msg_id"))


def q_sk4(spark, sf):
    back = _sent(spark, sf, "sk4", "msg_id")
    return echo_rows(back.select(F.col("key").alias("msg_id"), "value"), "value").select("msg_id", "output_pos", "comp_pos", "meta_id", "nombre", "result_location")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "fn01_resolve_format": q_fn01,
    "fn03_has_protocol": _uri_query({"has_protocol": fn.has_protocol}),
    "fn04_is_local": _uri_query({"is_local": fn.is_local}),
    "fn05_template_protocol": _uri_query({"protocol": fn.template_protocol}),
    "fn06_parse_s3_uri": q_fn06,
    "fn07_strip_protocol": _uri_query({"stripped": fn.strip_protocol}),
    "fn08_path_after_colon": _uri_query({"path": fn.path_after_colon}),
    "fn09_cache_key": _uri_query({"cache_key": fn.cache_key}),
    "fn10_sortable_id": q_fn10,
    "fn11_document_filename": q_fn11,
    "fn12_local_location": q_fn12,
    "fn13_object_key": q_fn13,
    "fn14_file_extension": _uri_query({"ext": fn.file_extension}),
    "fn15_file_extension_simple": _uri_query({"ext": fn.file_extension_simple}),
    "fn16_content_type": _uri_query({"content_type": fn.content_type}),
    "fn17_sanitize_path": _uri_query({"name": fn.sanitize_path}),
    "fn18_sanitize_template_path": _uri_query({"name": fn.sanitize_template_path}),
    "fn19_sanitize_s3_uri": _uri_query({"name": fn.sanitize_s3_uri}),
    "fn20_sanitize_http_url": _uri_query({"name": fn.sanitize_http_url}),
    "fn21_sanitize_map": q_fn21,
    "fn22_human_bytes": q_fn22,
    "fn23_sanitize_bucket": q_fn23,
    "fn24_file_name_of": _uri_query({"name": fn.file_name_of}),
    "fn25_sanitize_error_message": q_fn25,
    "fn26_request_summary": q_fn26,
    "fn27_template_file_name": _uri_query({"name": fn.template_file_name}),
    "fn28_cache_age": q_fn28,
    "fn29_safe_name_fallback": _uri_query({"name": fn.safe_name_fallback}),
    "so1_read_messages": q_so1,
    "so2_explode_kafka_batch": q_so2,
    "so3_decode_record": q_so3,
    "so3_decode_bytes": q_so3_bytes,
    "so4_decode_binary": q_so4,
    "so4_read_offsets": q_so4_offsets,
    "so6_land_templates": q_so6,
    "v1_check_structure": q_v1,
    "v2_check_composition": q_v2,
    "v3_check_data_node": q_v3,
    "v4_template_path": q_v4,
    "v5_check_image_payload": q_v5,
    "v7_check_protocol": q_v7,
    "v8_check_result_counts": q_v8,
    "v9_message_status": q_v9,
    "v10_classify_error": q_v10,
    "rs1_flatten_outputs": q_rs1,
    "rs2_only_templates": q_rs2,
    "rs3_project_request": q_rs3,
    "rs4_extract_images": q_rs4,
    "rs5_request_profile": q_rs5,
    "rs6_flatten_context": q_rs6,
    "rs8_flatten_context_json": q_rs8,
    "rn7_pdf_context": q_rn7,
    "rs6_flatten_deep": q_rs6_deep,
    "rs8_flatten_deep": q_rs8_deep,
    "rn8_text_deep": q_rn8_deep,
    "rn4_text_kinds": q_rn4_kinds,
    "v3_data_kinds": q_v3_kinds,
    "rs4_image_kinds": q_rs4_kinds,
    "rn6_many_templates": q_rn6_many,
    "rs10_collate_results": q_rs10,
    "rs13_request_from_flat": q_rs13,
    "j1_resolve_templates": q_j1,
    "j2_missing_templates": q_j2,
    "j3_requested_templates": q_j3,
    "j5_fresh_cache_lookup": q_j5,
    "st1_run_stream": q_st1,
    "st4_delivery": q_st4,
    "st2_template_fetch_state": q_st2,
    "st2_fetch_state_stream": q_st2_stream,
    "st3_evict_expired": q_st3,
    "sk1_write_documents": q_sk1,
    "sk2_write_local_copy": q_sk2,
    "sk3_write_responses": q_sk3,
    "sk4_write_responses_keyed": q_sk4,
    "a1_batch_summary": q_a1,
    "a1_batch_errors": q_a1_batches,
    "a2_record_count": q_a2,
    "a3_outputs_per_message": q_a3,
    "a4_requests_per_message": q_a4,
    "a5_distinct_protocols": q_a5,
    "a6_documents_by_format": q_a6,
    "a7_size_histogram": q_a7,
    "a7_render_duration": q_a7_duration,
    "a8_catalog_search": q_a8,
    "rn1_html_context": q_rn1,
    "rn2_image_mime": q_rn2,
    "rn6_render_html": q_rn6,
    "rn8_render_text": q_rn8,
    "rn10_render_report": q_rn10,
    "rn11_generate_documents": q_rn11,
    "sk5_failures": q_sk5,
    "sk6_document_catalog": q_sk6,
}
