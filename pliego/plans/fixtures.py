"""Inputs derived from the provided tables.

* ``messages``: one JSON business message per order (an order has a handful of
  lines; line numbers from 64 on would go to further messages). Outputs group the
  order's lines by line status, compositions are the lines. Order status and
  priority pick a few structurally broken messages (E1/E2/E3); line and
  supplier keys pick formats, template locations, images and empty data.
* ``kafka_records``: the ``events`` table as a topic: topic = event type,
  partition = user % 4, offset = event id, value = base64 of a message.
* ``template_requests``: template URIs requested over time (from ``events``).
* ``templates``: the template table (packaged templates + landed copies).

Every fixture is a pure DataFrame derivation, so its size grows with the
tables; the same rules are written as SQL in ``plans/oracle.py``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions._util import fenced, let
from ..schema import JSON_WRITE_OPTIONS
from ..sources.tables import table

LINES_PER_MESSAGE = 64

# Template locations used by the fixture (index = rule below).
BAD_LOCATIONS = [None, "../../etc/passwd", "templates/desconocido.html", "ftp@repo.example.com/plantillas/x.html"]
GOOD_LOCATIONS = [
    "orden.html",
    "reporte.html",
    "s3@plantillas.dev:v1/facturas/factura.html",
    "fs@/srv/plantillas/recibo.html",
    "http@https://cdn.example.com/t/aviso.html",
    "templates/orden.html",
]
# Output formats by part key (raw text: case and blanks kept).
FORMAT_CYCLE = ["txt", "html", " HTML", "TXT", "pdf", None, "XML"]
# Embedded images by part key (None = no images object).
IMAGE_CYCLE = [
    "iVBORw0KGgoAAAANSUhEUgAAAAEAAAAB",
    "/9j/4AAQSkZJRgABAQAAAQABAAD",
    "R0lGODlhAQABAIAAAP///wAAACH5BAEAAAAALAAAAAABAAEAAAICRAEAOw==",
    None,
    "!!notbase64",
    "UklGRiQAAABXRUJQVlA4IBgAAAAwAQCdASoBAAEAAwA0JaQAA3AA/vuUAAA=",
]


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


# The location of each remainder of 40: the bad ones once, then the good ones in turn.
LOCATION_CYCLE = [BAD_LOCATIONS[k] if k < 4 else GOOD_LOCATIONS[k % 6] for k in range(40)]


def location_rule(suppkey: Column, linenumber: Column) -> Column:
    """The JSON text of a line's template location."""
    return _pick_json(LOCATION_CYCLE, F.pmod(suppkey * 7 + linenumber, F.lit(40)))


def _escaped(text: Column) -> Column:
    """A text as it stands between the quotes of a JSON string."""
    js = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNotNull(), F.substr(js, F.lit(len('{"v":"') + 1), F.length(js) - len('{"v":""}')))


def _quoted(escaped: Column) -> Column:
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def _pick_json(values: list, index: Column) -> Column:
    """``_pick`` as JSON text, null for no value."""
    return F.coalesce(_pick([json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in values], index), F.lit("null"))


def composition(line: Column) -> Column:
    """The JSON text of a line's composition; the names of ``line`` are escaped already."""
    return let(_quoted(line["l_extendedprice"].cast("decimal(12,2)").cast("string")), lambda price: _composition(line, price))


def _composition(line: Column, price: Column) -> Column:
    """Spliced from its parts: only the customer's names need escaping, and they are
    escaped once a customer, so no line goes through a JSON writer."""
    part, number = line["l_partkey"], line["l_linenumber"]
    tax = F.concat(F.round(line["l_tax"] * 100).cast("int").cast("string"), F.lit("%"))
    image = [None if v is None else {"logo": v} for v in IMAGE_CYCLE]
    data = F.concat(
        F.lit('{"nombre":'), _quoted(line["c_name"]),
        F.lit(',"empresa":'), _quoted(line["c_mktsegment"]),
        F.lit(',"monto":'), price,
        F.lit(',"fecha":'), _quoted(F.date_format(line["l_shipdate"], "yyyy-MM-dd")),
        F.lit(',"codigo":'), _quoted(F.concat(F.lit("L"), line["l_orderkey"].cast("string"), F.lit("-"), number.cast("string"))),
        F.lit(',"cantidad":'), line["l_quantity"].cast("int").cast("string"),
        F.lit(',"items":[{"item":"base","precio":'), price,
        F.lit('},{"item":"impuesto","precio":'), _quoted(tax),
        F.lit('}],"cliente":{"nombre":'), _quoted(F.concat_ws(" / ", line["c_name"], line["n_name"])),
        F.lit(',"nacion":'), _quoted(line["n_name"]),
        F.lit('},"images":'), _pick_json(image, F.pmod(part, F.lit(len(IMAGE_CYCLE)))),
        F.lit("}"),
    )
    return F.concat(
        F.when(number % 5 == 0, F.lit('{"template":"plantilla","type":"static"')).otherwise(F.lit('{"template":"plantilla","type":"template"')),
        F.lit(',"resource":"documento","metadata":{"resource":{"input_format":"json","output_format":'),
        _pick_json(FORMAT_CYCLE, F.pmod(part, F.lit(len(FORMAT_CYCLE)))),
        F.lit(',"location":'), location_rule(line["l_suppkey"], number),
        F.lit(',"data":'), F.when(line["l_quantity"] != 50, data).otherwise(F.lit("null")),
        F.lit('},"result":{"location":null}}}'),
    )


# total order of lines inside an output (line numbers repeat in the data)
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_shipdate"]


def message_lines(spark: SparkSession, sf_dir: str, numbered: bool) -> DataFrame:
    """One row per composition-to-be with a line number (or without one), before
    nesting. The customer, names escaped for JSON, is joined to the order, so that
    lines are only shuffled by their order's key."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linestatus", *LINE_ORDER)
    li = li.where(F.col("l_linenumber").isNotNull() if numbered else F.col("l_linenumber").isNull())
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    cust = cust.join(nation, cust.c_nationkey == nation.n_nationkey, "left")
    cust = cust.select("c_custkey", *[_escaped(F.col(c)).alias(c) for c in ("c_name", "c_mktsegment", "n_name")])
    orders = orders.join(cust, F.col("o_custkey") == F.col("c_custkey"), "left")
    return li.join(orders, li.l_orderkey == orders.o_orderkey)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``msg_id STRING, raw STRING``: the message JSON text (SO1 input).

    One group-by per message (at most 64 line numbers each) gathers the lines'
    plain columns where the join by order key has put them; only then is each
    composition written, put in order, and the message text spliced together.
    Lines without a number are one message without an id.
    """
    def gathered(numbered: bool, *keys) -> DataFrame:
        line = F.struct("l_linestatus", "l_orderkey", *LINE_ORDER, "c_name", "c_mktsegment", "n_name")
        return message_lines(spark, sf_dir, numbered).groupBy(*keys).agg(
            F.first("o_orderkey").alias("orderkey"),
            F.first("o_orderstatus").alias("status"),
            F.first("o_orderpriority").alias("priority"),
            F.first("o_orderdate").alias("orderdate"),
            F.first("o_custkey").alias("custkey"),
            F.collect_list(line).alias("lines"),
        )

    part = F.floor((F.col("l_linenumber") - 1) / LINES_PER_MESSAGE).alias("part")
    msg_id = F.concat(F.lit("m"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("part").cast("string"))
    columns = ["msg_id", "orderkey", "status", "priority", "orderdate", "custkey", "lines"]
    grouped = gathered(True, "l_orderkey", part).withColumn("msg_id", msg_id).select(*columns)
    rest = gathered(False, F.col("l_linenumber").cast("string").alias("msg_id")).select(*columns)
    text = F.transform("lines", lambda x: F.struct(x["l_linestatus"].alias("l_linestatus"), F.struct(*[x[c].alias(c) for c in LINE_ORDER]).alias("ord"), composition(x).alias("json")))
    grouped = grouped.unionByName(rest).withColumn("lines", fenced(F.sort_array(text)))

    def output(status: str, kind: str) -> Column:
        texts = F.transform(F.filter("lines", lambda x: x["l_linestatus"] == status), lambda x: x["json"])
        return let(texts, lambda t: F.when(F.size(t) > 0, F.concat(
            F.lit('{"type":"' + kind + '","composicion":['), F.array_join(t, ","), F.lit("]}"),
        )))

    outs = F.array_join(F.array(output("F", "factura"), output("O", "orden")), ",")  # NULLs skipped
    status, prio = F.col("status"), F.col("priority")
    outputs = (
        F.when((status == "P") & (prio == "3-MEDIUM"), F.lit("[]"))  # E2
        .when((status == "P") & (prio == "2-HIGH"), F.concat(F.lit("["), outs, F.lit(',{"type":"anexo","composicion":null}]')))  # E3
        .otherwise(F.concat(F.lit("["), outs, F.lit("]")))
    )
    head = F.to_json(
        F.struct(
            F.lit("tpch").alias("output_producto"),
            prio.alias("output_subproducto"),
            F.struct(F.col("orderkey").alias("orden")).alias("output_metadata"),
        )
    )
    item = F.concat(F.substr(head, F.lit(1), F.length(head) - 1),
                    F.lit(',"outputs":'), outputs, F.lit(',"callback":null}'))
    meta = F.to_json(F.struct(
        F.col("msg_id").alias("id"), F.lit("tpch").alias("origen"), F.date_format("orderdate", "yyyy-MM-dd").alias("fecha")
    ))
    cliente = F.to_json(F.struct(F.col("custkey").alias("id")))
    nested = F.concat(F.lit('{"metadata":'), meta, F.lit(',"data":{"cliente":'), cliente, F.lit(',"item_canonico":'), item, F.lit("}}"))
    # E1: the flat request shape of the shipped sample events (no item_canonico)
    flat = F.to_json(F.struct(
        F.lit("orden.html").alias("templatePath"),
        F.struct(F.col("msg_id").alias("codigo"), F.col("custkey").alias("cliente")).alias("data"),
        F.lit(None).cast("map<string,string>").alias("images"),
    ), JSON_WRITE_OPTIONS)
    raw = F.when((status == "P") & (prio == "1-URGENT"), flat).otherwise(nested)
    return grouped.select("msg_id", fenced(raw).alias("raw"))


# ------------------------------------------------------------------ URIs ----


def uri_variants(url: Column) -> Column:
    """Template-URI spellings derived from a web URL (FIXTURES F12 ``uris``)."""
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+/?([^?#]*)", 1)
    return F.array(
        url,
        F.concat(F.lit("http@"), url),
        F.concat(F.lit("s3@"), host, F.lit(":"), path),
        F.concat(F.lit("fs@/srv/"), path),
        path,
        F.concat(F.lit("../"), path),
        F.concat(F.lit("/"), path),
        F.concat(F.lit("s3://"), host, F.lit("/"), path),
        F.concat(F.lit("C:\\plantillas\\"), path),
        F.concat(F.lit("ftp@"), host, F.lit("/"), path),
    )


def uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, variant, uri``: every page URL in ten template-URI forms."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return pages.select(
        "page_id", F.posexplode(uri_variants(F.col("url"))).alias("variant", "uri")
    ).withColumn("variant", F.col("variant").cast("bigint"))


# ------------------------------------------------------------- Kafka ----

KAFKA_BATCH_SIZE = 10  # records per batch, as the reference's event-source mapping
BAD_BASE64 = "not base64!!"
BAD_JSON = "{bad json"


def _b64(text: Column) -> Column:
    """Base64 without line breaks (``base64`` may chunk at 76 chars)."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", "")


def kafka_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a topic. Purchases carry a valid message, other events
    the flat sample shape (E1), error events a corrupt value."""
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    data = F.struct(
        F.col("event_type").alias("evento"),
        F.col("value").cast("decimal(12,2)").cast("string").alias("valor"),
        F.col("user_id").alias("usuario"),
    )
    comp = F.struct(
        F.lit("template").alias("type"),
        F.struct(
            F.struct(
                F.lit("txt").alias("output_format"),
                F.lit("orden.html").alias("location"),
                data.alias("data"),
            ).alias("resource")
        ).alias("metadata"),
    )
    nested = F.struct(
        F.struct(F.col("event_id").alias("id")).alias("metadata"),
        F.struct(
            F.struct(F.array(F.struct(F.lit("evento").alias("type"), F.array(comp).alias("composicion"))).alias("outputs")).alias(
                "item_canonico"
            )
        ).alias("data"),
    )
    flat = F.struct(F.lit("orden.html").alias("templatePath"), data.alias("data"))
    msg = F.when(F.col("event_type") == "purchase", F.to_json(nested)).otherwise(F.to_json(flat))
    value = (
        F.when((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0), F.lit(BAD_BASE64))
        .when(F.col("event_type") == "error", _b64(F.lit(BAD_JSON)))
        .otherwise(_b64(msg))
    )
    return ev.select(
        (F.col("event_id") / KAFKA_BATCH_SIZE).cast("bigint").alias("batch_id"),
        F.lit("document-requests").alias("topic_name"),
        F.col("event_type").alias("topic"),
        F.pmod(F.col("user_id"), F.lit(4)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.lit("CREATE_TIME").alias("timestampType"),
        F.concat(F.lit("request-"), F.col("event_id").cast("string")).alias("key"),
        value.alias("value"),
    )


def kafka_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Kafka batch envelope per 10 records: ``batch_id`` plus the
    ``records`` map (``topic-partition`` -> records in offset order)."""
    recs = kafka_records(spark, sf_dir)
    rec = F.struct(
        F.col("topic"), F.col("partition"), F.col("offset"), F.col("timestamp"),
        F.col("timestampType"), F.col("key"), F.col("value"), F.array().cast("array<string>").alias("headers"),
    )
    tp = recs.groupBy("batch_id", F.concat_ws("-", "topic", F.col("partition").cast("string")).alias("tp")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("offset").alias("o"), rec.alias("r")))).alias("l")
    )
    batch = tp.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("tp", F.transform("l", lambda x: x["r"]).alias("recs")))).alias("e")
    )
    return batch.select(
        "batch_id",
        F.lit("aws:kafka").alias("eventSource"),
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["tp"], x["recs"]))).alias("records"),
    )


def kafka_source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` in the row shape of Spark's Kafka source: the same messages as
    bytes, padded beyond a base64 line; error events are not JSON."""
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    text = F.concat(F.lit('{"metadata":{"id":'), F.col("event_id").cast("string"), F.lit(',"nota":"'), F.repeat(F.lit("ñandú "), 20), F.lit('"}}'))
    text = F.when(F.col("event_type") == "error", F.lit(BAD_JSON)).otherwise(text)
    header = F.struct(F.lit("origen").alias("key"), F.encode(F.lit("eventos"), "UTF-8").alias("value"))
    return ev.select(
        F.encode(F.concat(F.lit("request-"), F.col("event_id").cast("string")), "UTF-8").alias("key"),
        F.encode(text, "UTF-8").alias("value"),
        F.col("event_type").alias("topic"),
        F.pmod(F.col("user_id"), F.lit(4)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.pmod(F.col("event_id"), F.lit(2)).cast("int").alias("timestampType"),
        F.array(header).alias("headers"),
    )


def kafka_byte_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as records of which three in four hold bytes that are no UTF-8:
    a lone byte, a lead byte before an ASCII sign, a character cut short."""
    ev = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    odd = [F.encode(F.lit("ñ"), "UTF-8"), *[F.lit(bytearray(b)) for b in (b"\xff", b"\xc3(", b"\xf0\x9f\x98")]]
    n = F.pmod("event_id", F.lit(len(odd)))
    odd = F.coalesce(*[F.when(n == i, v) for i, v in enumerate(odd)])
    head = F.concat(F.lit('{"metadata":{"id":'), F.col("event_id").cast("string"), F.lit('},"nota":"'))
    return ev.select(
        F.col("event_type").alias("topic"), F.pmod(F.col("user_id"), F.lit(4)).cast("int").alias("partition"), F.col("event_id").alias("offset"),
        F.concat(F.lit("request-"), F.col("event_id").cast("string")).alias("key"),
        F.concat(F.encode(head, "UTF-8"), odd, F.encode(F.lit('"}'), "UTF-8")).alias("value"),
    )


# ------------------------------------- conversations as nested data ----


def _json(c: Column) -> Column:
    """A text as a JSON string."""
    return F.substr(F.to_json(F.struct(c.alias("x"))), F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return t.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def nested_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, data``: an object eight levels deep, lists in lists, a leaf
    name that comes again, a null and a fraction."""
    t = _turns(spark, sf_dir)
    turn, role = F.col("turn").cast("string"), _json(F.col("role"))
    data = F.concat(
        F.lit('{"hoja":"primera","a":{"b":{"c":{"d":{"e":{"f":{"g":{"hoja":'), _json(F.col("text")), F.lit(',"n":'), turn,
        F.lit('.50}}}}}}},"lista":[['), turn, F.lit(",["), role, F.lit(']],{"x":{"y":'), role, F.lit('}},null],"nada":null,"ok":true}'),
    )
    return t.select("conv_id", "turn", data.alias("data"))


KIND_TEMPLATE = "{{#lista}}L:{{lista}};{{/lista}}{{#falso}}F:{{{falso}}};{{/falso}}{{^no}}N{{/no}}{{#objeto}}{{objeto}}{{/objeto}}{{=<% %>=}}<%& lista %>|<% vacio %>"


def text_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    data = F.concat(
        F.lit('{"lista":'), _json(F.concat(F.lit("[urgente] "), F.col("role"))), F.lit(',"falso":"false","no":false,"objeto":'),
        _json(F.concat(F.lit("{"), F.col("turn").cast("string"), F.lit("}"))), F.lit(',"vacio":[]}'),
    )
    return t.select("conv_id", "turn", data.alias("data"))


def data_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``msg_id, raw``: a plain-text document whose data node is, by turn, an
    object, a text that looks like one, a list, or null."""
    t = _turns(spark, sf_dir)
    data = _pick(['{"a":"b"}', '"{\\"a\\":\\"b\\"}"', '[{"a":"b"}]', "null"], F.pmod(F.col("turn"), F.lit(4)))
    raw = F.concat(
        F.lit('{"data":{"item_canonico":{"outputs":[{"type":"o","composicion":[{"type":"template","metadata":{"resource":{"output_format":"txt","location":"orden.html","data":'),
        data, F.lit("}}}]}]}}}"),
    )
    return t.select(F.concat_ws("-", "conv_id", "turn").alias("msg_id"), raw.alias("raw"))


def image_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images twice (the last counts), as a text that looks like an object, nested, or null."""
    t = _turns(spark, sf_dir)
    data = _pick(
        ['{"images":{"logo":"x"},"images":{"logo":"y"}}', '{"images":"{\\"logo\\":\\"x\\"}"}', '{"images":{"logo":{"a":"b"}}}', '{"images":{"logo":"z","otro":null}}', '{"images":null}'],
        F.pmod(F.col("turn"), F.lit(5)),
    )
    return t.select("conv_id", "turn", data.alias("data"))


# ------------------------------------------------ a template for each page ----


def page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template table with one row per page, under a name without a known suffix;
    every tenth is malformed."""
    p = table(spark, sf_dir, "pages", "page_id")
    number = F.col("page_id").cast("string")
    good = F.concat(F.lit("<h1>{{titulo}}</h1>{{#lista}}<li>{{x}}</li>{{/lista}}<p>P"), number, F.lit(" {{{titulo}}}</p>"))
    bad = F.concat(F.lit("<p>P"), number, F.lit("{{#lista}}{{x}}</p>"))
    return p.select(
        F.lit("packaged").alias("source"), F.concat(F.lit("templates/paginas/"), number, F.lit(".tpl")).alias("key"),
        F.when(F.pmod(F.col("page_id"), F.lit(10)) == 3, bad).otherwise(good).alias("content"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched_at"),
    )


def page_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages", "page_id", "url")
    number = F.col("page_id").cast("string")
    raw = F.concat(
        F.lit('{"data":{"item_canonico":{"outputs":[{"type":"o","composicion":[{"type":"template","metadata":{"resource":{"output_format":"html","location":"paginas/'), number,
        F.lit('.tpl","data":{"titulo":'), _json(F.coalesce("url", F.lit(""))), F.lit(',"lista":[{"x":'), number, F.lit('},{"x":"a&b"}]}}}}]}]}}}'),
    )
    return p.select(F.concat(F.lit("p"), number).alias("msg_id"), raw.alias("raw"))


# ---------------------------------------------------- template requests ----


def page_uri(page_id: Column) -> Column:
    """A page's template as a URI of the mount, in folders of 100."""
    return F.concat(F.lit("fs@/paginas/"), F.floor(page_id / 100).cast("string"), F.lit("/"), page_id.cast("string"), F.lit(".html"))


def mount_pages(spark: SparkSession, sf_dir: str, root: str, mark: str, there: Column) -> None:
    """Write a template file for each page for which ``there`` holds: ``mark`` and its URL."""
    pages = table(spark, sf_dir, "pages", "page_id", "url").where(there)
    rows = pages.select(F.substr(page_uri(F.col("page_id")), F.lit(4)).alias("path"), F.concat(F.lit(mark), F.coalesce("url", F.lit(""))).alias("text"))

    def write(batches):
        from ..sources.topic import open_store

        store, base = open_store(root)
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store.create_dir(base + path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(base + path) as f:
                    f.write(text.encode())
            yield b

    rows.mapInArrow(write, "path string, text string").write.format("noop").mode("overwrite").save()


def template_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``uri, ts, event_id``: template fetch requests over time (ST2, J5)."""
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    uri = F.concat(F.lit("s3@plantillas.dev:v1/u"), F.pmod(F.col("user_id"), F.lit(7)).cast("string"), F.lit(".html"))
    return ev.select(uri.alias("uri"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
