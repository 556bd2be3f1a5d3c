"""Whole pipeline on hand-written messages (FIXTURES F1, F2, F6)."""

import json

import pytest
from pyspark.sql import functions as F

from pliego.plans.pipeline import generate_documents
from pliego.plans.queries import templates as template_table
from pliego.operators.reshape import locations_of


def comp(location, fmt, data=None, ctype="template"):
    return {
        "template": "t", "type": ctype, "resource": "r",
        "metadata": {"resource": {"output_format": fmt, "location": location, "data": data}},
    }


def message(outputs, **extra):
    m = {"metadata": {"id": 1}, "data": {"item_canonico": {"outputs": outputs}}}
    m["data"]["item_canonico"].update(extra)
    return json.dumps(m)


DATA = {"nombre": "Ana", "monto": 1500.50, "cliente": {"nombre": "B"}}


@pytest.fixture(scope="module")
def run(spark):
    tpl = template_table(spark)

    def go(*raws):
        df = spark.createDataFrame([(f"m{i}", r) for i, r in enumerate(raws)], "msg_id string, raw string")
        return generate_documents(df, tpl, "2024-02-01 00:00:00")

    return go


def status(g):
    return {r["msg_id"]: (r["ok"], r["error_code"], r["error_message"]) for r in g.messages.collect()}


def test_two_templates_in_order(run):
    raw = message([{"type": "o", "composicion": [comp("reporte.html", "pdf", DATA), comp("orden.html", "html", DATA)]}])
    g = run(raw)
    assert status(g)["m0"][0] is True
    docs = g.documents.orderBy("comp_pos").select("comp_pos", "format", "status").collect()
    assert [(d[0], d[1], d[2]) for d in docs] == [(0, "pdf", "needs_converter"), (1, "html", "rendered")]


def test_error_catalogue(run):
    g = run(
        json.dumps({"templatePath": "x", "data": {"codigo": "1"}}),  # E1
        message([]),  # E2
        message([{"type": "o", "composicion": None}]),  # E3 with 'o'
        message([{"type": None}]),  # E3 with 'null'
        message([{"type": "o", "composicion": [comp("a.html", "txt", None)]}]),  # E4
        message([{"type": "o", "composicion": [comp("../../etc/passwd", "txt", DATA)]}]),  # E5
        message([{"type": "o", "composicion": [comp("templates/none.html", "html", DATA)]}]),  # E6
        message([{"type": "o", "composicion": [comp("x.odt", "pdf", dict(DATA, images={"a": "!!x"}))]}]),
    )
    s = status(g)
    assert s["m0"][1:] == ("E1", "El mensaje de Sentry está incompleto o le falta 'data.item_canonico'.")
    assert s["m1"][1:] == ("E2", "Falta la lista de outputs de 'item_canonico'.")
    assert s["m2"][1:] == ("E3", "El output 'o' no tiene entradas de 'composicion'.")
    assert s["m3"][1:] == ("E3", "El output 'null' no tiene entradas de 'composicion'.")
    assert s["m4"][1] == "E4"
    assert s["m5"][2] == "Invalid template path: ../../etc/passwd. Path must not contain '..' or absolute paths."
    assert s["m6"][2] == "Template not found: templates/none.html"
    assert s["m7"][1] in ("E6", "E7")


def test_no_template_composition_passes_unchanged(run):
    raw = message([{"type": "o", "composicion": [comp("x", "pdf", DATA, ctype="static")]}])
    g = run(raw)
    assert status(g)["m0"][0] is True
    assert g.documents.count() == 0


def test_single_object_accepted_as_array(run):
    single = json.loads(message([]))
    single["data"]["item_canonico"]["outputs"] = {"type": "o", "composicion": comp("orden.html", "txt", DATA)}
    g = run(json.dumps(single))
    assert status(g)["m0"][0] is True
    assert g.documents.count() == 1


def test_text_document_and_collation(run):
    raw = message([{"type": "o", "composicion": [comp("orden.html", "txt", DATA)]}], unknown_field=1)
    g = run(raw)
    body = g.documents.first()["body"]
    assert "Template: orden.html" in body
    assert "monto                : 1500.5\n" in body
    assert "cliente              : {nombre=B}\n" in body
    resp = g.messages.first()["response"]
    assert "unknown_field" not in resp
    loc = locations_of(g.messages).first()
    assert loc["result_location"].startswith("fs@/temp/") and loc["result_location"].endswith(".txt")


def test_rerun_names_the_same_files(run):
    raw = message([{"type": "o", "composicion": [comp("orden.html", "html", DATA)]}])
    a = run(raw).documents.select("location").first()[0]
    b = run(raw).documents.select("location").first()[0]
    assert a == b


def test_join_path_agrees_with_in_row_path(spark, run, monkeypatch):
    """Large template tables resolve by join; the outcome must not change."""
    import pliego.plans.pipeline as P
    from pliego.plans import fixtures

    msgs = fixtures.messages(spark, "/root/testdata/sf0.001")
    tpl = template_table(spark)
    a = generate_documents(msgs, tpl, "2024-02-01 00:00:00")
    monkeypatch.setattr(P, "MAX_TEMPLATE_KEYS", 0)
    b = P.generate_documents(msgs, tpl, "2024-02-01 00:00:00")
    cols = ["msg_id", "ok", "error_code", "error_message"]
    assert sorted(a.messages.select(cols).collect()) == sorted(b.messages.select(cols).collect())
    key = ["msg_id", "output_pos", "comp_pos", "status", F.coalesce("location", F.lit("-")).alias("location"), F.coalesce("body", F.lit("-")).alias("body")]
    one, two = sorted(a.documents.select(key).collect()), sorted(b.documents.select(key).collect())
    assert one == two
    assert all((r.body == "-") == (r.status == "needs_converter") == (r.location == "-") for r in one)


TEMPLATES = "source string, key string, content string, fetched_at timestamp"


def test_any_template_name_and_malformed_templates(spark):
    tpl = spark.createDataFrame(
        [("packaged", "templates/x.tpl", "Hola {{nombre}}", None), ("packaged", "templates/mal.html", "{{#a}}x", None), ("file", "local/y", "{{monto}}", None)], TEMPLATES
    )
    raws = [message([{"type": "o", "composicion": [comp(loc, "html", DATA)]}]) for loc in ("x.tpl", "mal.html", "local/y")]
    df = spark.createDataFrame([(f"m{i}", r) for i, r in enumerate(raws)], "msg_id string, raw string")
    for limit in (100, 0):
        g = generate_documents(df, tpl, "2024-02-01 00:00:00", key_limit=limit)
        s = status(g)
        assert s["m0"][0] and s["m2"][0]
        assert s["m1"][1:] == ("E8", "Failed to generate HTML document: Failed to close 'a' tag")
        assert {r.msg_id: r.body for r in g.documents.collect()} == {"m0": "Hola Ana", "m2": "1500.5"}


def test_pdf_looks_in_the_package_folder_only(run):
    raws = [message([{"type": "o", "composicion": [comp("templates/orden.html", f, DATA)]}]) for f in ("pdf", "html")]
    s = status(run(*raws))
    assert s["m0"][1:] == ("E6", "Template not found: templates/orden.html") and s["m1"][0]


def test_pending_documents_have_no_location(run):
    raw = message([{"type": "o", "composicion": [comp("reporte.html", "pdf", DATA), comp("orden.html", "txt", DATA)]}])
    g = run(raw)
    m = g.messages.first()
    assert (m.ok, m.documents, m.pending) == (True, 1, 1)
    assert [r.result_location is None for r in locations_of(g.messages).orderBy("comp_pos").collect()] == [True, False]


def test_registered_renderer(spark, run):
    """U1: a converter turns pending documents into written ones."""
    from pliego.operators import render

    def convert(df):
        return df.withColumn("body", F.concat(F.lit("%PDF "), "template_path")).withColumn("status", F.lit("rendered"))

    render.register_renderer("pdf", convert)
    try:
        g = run(message([{"type": "o", "composicion": [comp("reporte.html", "pdf", DATA)]}]))
        d, m = g.documents.first(), g.messages.first()
        assert (d.body, d.status) == ("%PDF reporte.html", "rendered") and d.location.endswith(".pdf")
        assert (m.documents, m.pending) == (1, 0) and locations_of(g.messages).first().result_location == d.location
    finally:
        render.RENDERERS.clear()


def test_registered_template_source(spark):
    """U2: rows of a registered source join the template table."""
    from pliego.sources import templates as T

    T.register_template_source("http", lambda s: s.createDataFrame([("http", "espejo.example.com/z.html", "Z {{nombre}}", None)], TEMPLATES))
    try:
        raw = message([{"type": "o", "composicion": [comp("http@https://espejo.example.com/z.html", "html", DATA)]}])
        df = spark.createDataFrame([("m", raw)], "msg_id string, raw string")
        assert generate_documents(df, template_table(spark), "2024-02-01 00:00:00").documents.first().body == "Z Ana"
    finally:
        T.TEMPLATE_SOURCES.clear()


def test_data_given_as_text_is_no_object(run):
    s = status(run(message([{"type": "o", "composicion": [comp("orden.html", "txt", json.dumps(DATA))]}])))
    assert s["m0"][1] == "E4b"


def test_message_ids_do_not_follow_the_splits(spark, tmp_path):
    from pliego.sources.messages import read_messages

    (tmp_path / "m.jsonl").write_text("\n".join(['{"a":%d}' % (i % 7) for i in range(40)]))
    ids = []
    for size in ("64", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        ids.append(sorted(r.msg_id for r in read_messages(spark, str(tmp_path)).collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids[0] == ids[1] and len(set(ids[0])) == 40


def test_a_hot_message_is_numbered_in_many_tasks(spark, tmp_path):
    from pliego.sources.messages import read_messages

    n = 40_000
    (tmp_path / "m.jsonl").write_text("\n".join(['{"a":1}'] * n + ['{"a":2}', '{"a":3}', '{"a":2}']))
    rows = read_messages(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    numbers = {}
    for r in rows:
        numbers.setdefault(r.raw, []).append(r.msg_id.rsplit(":", 1)[1])
    assert sorted(map(int, numbers['{"a":1}'])) == list(range(1, n + 1))
    assert sorted(numbers['{"a":2}']) == ["1", "2"] and len(numbers['{"a":3}']) == 1
    assert len({r.task for r in rows if r.raw == '{"a":1}'}) > 1


def test_asof_lookup_against_brute_force(spark):
    import datetime
    import random

    from pliego.operators.lookup import fresh_cache_lookup

    random.seed(5)
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=random.randint(0, 20_000))
    cache = [(random.choice("ab"), at()) for _ in range(30)]
    reqs = [(i, random.choice("abc"), at()) for i in range(600)] + [(i, u, t) for i, (u, t) in enumerate(cache, 1000)]
    got = fresh_cache_lookup(spark.createDataFrame(reqs, "i int, uri string, ts timestamp"), spark.createDataFrame(cache, "uri string, fetched_at timestamp"))
    exp = {i: max((f for k, f in cache if k == u and f <= t and (t - f).total_seconds() < 7200), default=None) for i, u, t in reqs}
    assert {r.i: r.entry_at for r in got.collect()} == exp and got.count() == len(reqs)


def fold(rows):
    exp, entry = [], {}
    for u, t in sorted(rows):
        f = u not in entry or (t - entry[u]).total_seconds() >= 7200
        if f:
            entry[u] = t
        exp.append((u, t, f, entry[u]))
    return sorted(exp)


def test_fetch_state_batch_matches_fold(spark):
    import datetime
    import random

    from pliego.streaming.cache_state import fetch_state

    base = datetime.datetime(2024, 1, 1)
    rows = [("u", base + datetime.timedelta(minutes=m)) for m in (0, 60, 130, 200, 260)]
    out = fetch_state(spark.createDataFrame(rows, "uri string, ts timestamp")).orderBy("ts").collect()
    assert [r.fetched for r in out] == [True, False, True, False, True]  # FIXTURES F11
    random.seed(7)
    for days in (10, 900):
        rows = [(u, base + datetime.timedelta(seconds=random.randint(0, days * 86400))) for u in ["a", "hot", "hot", "hot"] for _ in range(800)]
        got = sorted(tuple(r) for r in fetch_state(spark.createDataFrame(rows, "uri string, ts timestamp")).collect())
        assert got == fold(rows)


def test_fetch_state_stream_matches_batch(spark, tmp_path):
    """Requests in several files, out of order within the delay."""
    import datetime
    import random

    from pliego.streaming.cache_state import fetch_state_stream

    base = datetime.datetime(2024, 1, 1)
    random.seed(9)
    rows = [(random.choice("ab"), base + datetime.timedelta(seconds=60 * i + random.randint(0, 500))) for i in range(600)]
    end = [(u, base + datetime.timedelta(days=30)) for u in "ab"]
    for i in range(4):
        part = rows[150 * i : 150 * (i + 1)] + (end if i == 3 else [])
        spark.createDataFrame(part, "uri string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    src = spark.readStream.schema("uri string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = fetch_state_stream(src).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [r for r in got if r[1] < end[0][1]] == fold(rows)


def test_stream_replay_rewrites_the_same_rows(spark, tmp_path):
    """ST4: a batch that is processed again, as after a restart, adds nothing."""
    from pliego.plans import fixtures
    from pliego.streaming.stream import StreamOutputs, process_batch

    recs = fixtures.kafka_records(spark, "/root/testdata/sf0.001").where("offset < 200").drop("batch_id", "topic_name")
    out = StreamOutputs(str(tmp_path))
    rows = []
    for _ in range(2):
        process_batch(recs, 7, lambda: template_table(spark), out)
        rows.append({n: sorted(map(str, spark.read.parquet(out.path(n)).collect())) for n in ("results", "documents", "responses", "failures", "summary")})
    assert rows[0] == rows[1] and len(rows[0]["results"]) == 200
    assert len(rows[0]["responses"]) + len(rows[0]["failures"]) == 200


def test_each_message_is_parsed_once(spark):
    """Filters that Spark infers from the explodes must not repeat the parse of a message,
    nor may the texts be built again for each mention."""
    from pliego.operators.reshape import flatten_outputs
    from pliego.plans import fixtures
    from pliego.sources.messages import parse_messages

    rows = flatten_outputs(parse_messages(fixtures.messages(spark, "/root/testdata/sf0.001")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter " in line]
    assert not any("from_json" in line or "to_json" in line or "StructsToJson" in line for line in filters)
    assert plan.count("StructField(_corrupt,StringType,true), (mode") == 2  # one for each of the two paths


def test_echo_is_parsed_once(spark):
    """The response names the echoed message many times and parses it once a path."""
    from pliego.operators.collate import collated_response

    one = spark.createDataFrame([('{"data":{"item_canonico":{"outputs":[]}}}',)], "raw string")
    out = one.select(collated_response(F.col("raw"), lambda i, k, c: F.lit("x")).alias("r"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(metadata,VariantType") == 2
    assert out.first().r is not None


def test_lines_without_a_number_are_one_message(spark, tmp_path):
    """Lines are gathered by their order's key; those without a number have no message
    id and stay one message, over all orders."""
    import datetime as dt

    from pliego.plans import fixtures

    d = str(tmp_path)
    day = dt.datetime(2024, 1, 1)
    lines = [(o, 1, 1, n, 1.0, 2.0, 0.1, "O", day) for o, n in [(1, 1), (1, 65), (1, 2), (2, 1), (2, None), (1, None)]]
    ddl = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, ddl).write.parquet(f"{d}/lineitem.parquet")
    orders = [(o, 1, "O", day, "5-LOW") for o in (1, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(1, "Ana", "X", 1)], "c_custkey long, c_name string, c_mktsegment string, c_nationkey int").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(1, "PERU")], "n_nationkey int, n_name string").write.parquet(f"{d}/nation.parquet")
    got = {r.msg_id: r.raw.count('"template":"plantilla"') for r in fixtures.messages(spark, d).collect()}
    assert got == {"m1-0": 2, "m1-1": 1, "m2-0": 1, None: 2}


def test_a_fence_is_no_projection_of_its_own(spark):
    """The parse copies a message's columns once a step: the path, the parse, the view."""
    from pliego.sources.messages import parse_messages

    rows = parse_messages(spark.range(2).select(F.col("id").cast("string").alias("msg_id"), F.concat(F.lit("{"), F.col("id")).alias("raw")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project [") <= 4  # the fourth makes the test's rows


@pytest.mark.parametrize("name", ["sk2_write_local_copy", "v8_check_result_counts"])
def test_what_is_read_again_was_written_once(spark, tmp_path, name):
    """Messages, or documents, that a query takes more than once aren't made again each time."""
    import datetime as dt

    import __spark_entry__ as entry

    d, day = str(tmp_path), dt.datetime(2024, 1, 1)
    lines = [(o, 7, 1, n, 1.0, 2.0, 0.1, "O", day) for o in (7, 8, 11) for n in (1, 2, 3)]
    ddl = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, ddl).write.parquet(f"{d}/lineitem.parquet")
    orders = [(o, 1, "O", day, "5-LOW") for o in (7, 8, 11)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(1, "Ana", "X", 1)], "c_custkey long, c_name string, c_mktsegment string, c_nationkey int").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(1, "PERU")], "n_nationkey int, n_name string").write.parquet(f"{d}/nation.parquet")
    out = entry.queries()[name](spark, d)
    assert "lineitem.parquet" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.msg_id: r for r in out.collect()}
    if name.startswith("v8"):
        assert {k: (r.templates, r.results) for k, r in got.items()} == {"m7-0": (3, 2), "m11-0": (3, 4)}
    else:
        assert set(got) == {"m7-0", "m8-0", "m11-0"} and all(r.body for r in got.values())
