"""What a message's or a request's row does once, or only where it is needed."""

from pyspark.sql import functions as F

from pliego.sources.messages import CORRUPT, DIRECT_DDL, parse_messages

COMP = '{"type":"template","metadata":{"resource":{"output_format":"txt","location":"a.html","data":%s}}}'
MESSAGE = '{"metadata":{"id":1},"data":{"item_canonico":{"outputs":[{"type":"o","composicion":[%s]}]}}}'


def _rows(spark, *raws):
    return spark.createDataFrame([(f"m{i}", r) for i, r in enumerate(raws)], "msg_id string, raw string")


def test_plain_messages_are_not_searched(spark):
    """The text is searched for lone objects and text data only where the direct parse leaves it open."""
    from pliego.sources.messages import unsure

    plain = ['{"a":1.50}', '"abc"', "[1]", "null", '{"outputs":{"a":1}}', '{"t":"x","data":"y"}']
    open_ = ["{}", '"{}"', '" {}"', '"{abc"', '"{\\"a\\":1}"', '"\\u007b\\"a\\":1}"']
    lone = MESSAGE.replace("[%s]", "%s") % (COMP % '{"a":1}')
    df = _rows(spark, *[MESSAGE % (COMP % d) for d in plain + open_], lone)
    direct = F.from_json("raw", DIRECT_DDL, {"columnNameOfCorruptRecord": CORRUPT})
    got = {r.msg_id: r.u for r in df.withColumn("d", direct).select("msg_id", unsure(F.col("raw"), F.col("d")).alias("u")).collect()}
    assert [got[f"m{i}"] for i in range(df.count())] == [False] * len(plain) + [True] * (len(open_) + 1)


def test_text_data_is_told_from_objects(spark):
    """Data that only looks like an object isn't one, however key and text are written."""
    objects = ['{"a":1}', "{}", "{ }", '{ "a" : 1 }', '{"data":"{}"}']
    others = ['"{}"', '"{ }"', '" {}"', '"{abc"', '"{\\"a\\":1}"', '"\\u007b\\"a\\":1}"', "[1]", "7", "null"]
    both = [(d, True) for d in objects] + [(d, False) for d in others]
    raws, want = [], []
    for d, is_object in both:
        for key in ('"data":', '"data" : ', '"d\\u0061ta":'):
            raws.append(MESSAGE % (COMP % d).replace('"data":', key, 1))
            want.append(is_object)
    got = {r.msg_id: r.x for r in parse_messages(_rows(spark, *raws)).select("msg_id", F.col("outputs")[0]["composicion"][0]["data_is_object"].alias("x")).collect()}
    assert [got[f"m{i}"] for i in range(len(raws))] == want


def test_fields_are_counted_without_their_values(spark):
    from pliego.operators.jsontext import as_map, keys
    from pliego.operators.reshape import project_request, request_profile

    texts = [None, "", "null", "7", '"x"', "[]", '[{"a":1}]', "{}", '{"a":1,"b":null}', '{"a":1,"a":{"c":2}}', '{"":1}', '{"a":1', "{} x"]
    df = spark.createDataFrame([(t,) for t in texts], "data string")
    for r in df.select("data", F.size(keys(F.col("data"))).alias("n"), F.size(F.map_keys(as_map(F.col("data")))).alias("m")).collect():
        assert r.n == r.m, r.data
    ask = df.select(F.lit("m").alias("msg_id"), F.lit(0).alias("output_pos"), F.lit(0).alias("comp_pos"), F.lit("a").alias("location"), "data", F.lit("txt").alias("output_format"))
    plan = request_profile(project_request(ask))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1  # the images


def test_images_are_decoded_once_and_for_html_alone(spark):
    from pliego.functions import sniff_image_mime
    from pliego.operators.render import rendered

    df = spark.createDataFrame([(f, {"logo": "iVBORw0KGgoAAAANSUhEUgAAAAEAAAAB"}) for f in ("html", "txt", "pdf")], "f string, i map<string,string>")
    plan = df.select(sniff_image_mime(F.col("i")["logo"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unbase64(") == 1
    made = df.select("f", rendered("f", F.lit("a.html"), F.lit("{{imagen_logo}}"), F.lit('{"a":1}'), "i")["body"].alias("b"))
    texts = made._jdf.queryExecution().optimizedPlan().toString()
    assert "= html) THEN" in texts
    got = {r.f: r.b for r in made.collect()}
    assert got["html"].startswith("data:image/png;base64,iVBOR") and "a                    : 1" in got["txt"] and got["pdf"] is None


def _small(spark):
    ok = MESSAGE % ",".join(COMP % d for d in ('{"a":1.50,"images":{"logo":"iVBORw0KGgo="}}', '{"b":"x"}')).replace("a.html", "orden.html")
    bad = [MESSAGE % (COMP % "[1]"), MESSAGE % (COMP % '"x"'), "{", None]
    return _rows(spark, ok, ok.replace('"txt"', '"pdf"'), ok.replace('"txt"', '"html"'), *bad)


def test_kept_status_gives_the_same_rows(spark, tmp_path):
    """Messages and documents read from one kept status are those computed without it, on either path."""
    from pliego.plans.pipeline import generate_documents
    from pliego.plans.queries import AS_OF, templates

    for path, limit in (("listed", None), ("joined", 0)):
        plain = generate_documents(_small(spark), templates(spark), AS_OF, key_limit=limit)
        once = generate_documents(_small(spark), templates(spark), AS_OF, key_limit=limit, kept=str(tmp_path / path))
        for a, b in ((plain.messages, once.messages), (plain.documents.drop("render_us"), once.documents.drop("render_us"))):
            assert a.columns == b.columns
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert once.documents.count() == 6


def test_whole_pipeline_builds_each_message_once(spark, monkeypatch):
    """rn11: a message's text is computed once for its status and its documents."""
    from pliego.plans import fixtures
    from pliego.plans.queries import q_rn11

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(raw):
        made.add(1)
        return raw

    texts = _small(spark).withColumn("raw", counted.asNondeterministic()("raw"))
    monkeypatch.setattr(fixtures, "messages", lambda spark, sf: texts)
    rows = {r.msg_id: r for r in q_rn11(spark, "small").collect()}
    assert made.value == len(rows) == 7
    assert [rows[f"m{i}"].bodies is not None for i in range(7)] == [True] * 3 + [False] * 4


def test_local_copies_and_locations_parse_each_message_once(spark, monkeypatch):
    """sk2: the documents are made from the status that the responses are read from."""
    from pliego.plans import fixtures
    from pliego.plans.queries import q_sk2
    from pliego.sinks import store

    plans = []
    write = store.write_local_copy

    def seen(documents, *args):
        plans.append(documents._jdf.queryExecution().optimizedPlan().toString())
        return write(documents, *args)

    monkeypatch.setattr(store, "write_local_copy", seen)
    monkeypatch.setattr(fixtures, "messages", lambda spark, sf: _small(spark))
    rows = q_sk2(spark, "small").collect()
    assert len(rows) == 4 and all(r.body for r in rows)
    assert plans and CORRUPT not in plans[0]


def test_a_line_is_written_without_a_json_writer(spark, tmp_path):
    """Names are escaped once a customer; the spliced text is still the JSON of its values, nulls written out."""
    import datetime
    import json

    from pliego.plans import fixtures

    odd = ['a"b', "c\\d", "e\nf", "", "ñ 漢😀", "\x01", None]
    when = datetime.datetime(1995, 3, 1)
    tables = {
        "nation": ([(i, n) for i, n in enumerate(odd)], "n_nationkey long, n_name string"),
        "customer": ([(i, n, odd[-i], i) for i, n in enumerate(odd)], "c_custkey long, c_name string, c_mktsegment string, c_nationkey long"),
        "orders": ([(i, i, "O", when, "5-LOW") for i in range(len(odd))], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(i, "O", 1, i if i else None, i, 50.0 if i == 2 else 7.0, 1.5 if i else None, 0.05, when) for i in range(len(odd))],
                     "l_orderkey long, l_linestatus string, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_tax double, l_shipdate timestamp"),
    }
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    texts = fixtures.messages(spark, str(tmp_path))
    assert texts._jdf.queryExecution().optimizedPlan().toString().count("input_format,StringType") == 0
    got = {json.loads(r.raw)["data"]["cliente"]["id"]: json.loads(r.raw)["data"]["item_canonico"]["outputs"][0]["composicion"][0] for r in texts.collect()}
    assert len(got) == len(odd)
    for i, name in enumerate(odd):
        resource = got[i]["metadata"]["resource"]
        if i == 2:
            assert resource["data"] is None
            continue
        data = resource["data"]
        assert data["nombre"] == data["cliente"]["nacion"] == name and data["empresa"] == odd[-i]
        assert data["cliente"]["nombre"] == ("" if name is None else f"{name} / {name}")
        assert data["monto"] == data["items"][0]["precio"] == ("1.50" if i else None) and data["items"][1]["precio"] == "5%"
        assert (data["images"] is None) == (i in (0, 3)) and (resource["output_format"] is None) == (i in (0, 5))
        assert data["cantidad"] == 7 and data["fecha"] == "1995-03-01" and data["codigo"] == f"L{i}-1"


def test_formats_are_trimmed_once(spark):
    from pliego.functions import resolve_format
    from pliego.functions._util import is_blank

    texts = [None, "", " ", "\x00\t\n", "html", " HTML\n", "\x01txt ", "pdf", "xml", "ht ml", "txt \u0085", " txt", "  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    made = df.select("t", resolve_format(F.col("t")).alias("f"), is_blank(F.col("t")).alias("b"))
    assert made.select("f")._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [r.f for r in made.collect()] == ["pdf"] * 4 + ["html", "html", "txt"] + ["pdf"] * 6
    assert [r.b for r in made.collect()] == [True] * 4 + [False] * 9
