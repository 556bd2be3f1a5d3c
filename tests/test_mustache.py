"""Templates bound by the rendering UDF: Mustache rules, node kinds, errors."""

import pytest
from pyspark.sql import functions as F

from pliego.operators.mustache import TemplateError, parse
from pliego.operators.render import rendered

DATA = '{"nombre":"Ana & <Co>","items":[{"item":"a","precio":"1"},{"item":"b","precio":"2"}],"vacio":"","cero":0,"f":false}'


def render(spark, source, data=DATA, images=None):
    df = spark.createDataFrame([(source, data, images or {})], "c string, d string, i map<string,string>")
    return df.select(rendered(F.lit("html"), F.lit("x.html"), "c", "d", "i")["body"]).first()[0]


def test_variable_escape(spark):
    assert render(spark, "<p>{{nombre}}</p>") == "<p>Ana &amp; &lt;Co&gt;</p>"
    assert render(spark, "{{{nombre}}}|{{&nombre}}") == "Ana & <Co>|Ana & <Co>"
    assert render(spark, "[{{missing}}]") == "[]"


def test_sections(spark):
    assert render(spark, "{{#items}}{{item}}={{precio}};{{/items}}") == "a=1;b=2;"
    assert render(spark, "{{#vacio}}x{{/vacio}}{{^vacio}}empty{{/vacio}}") == "empty"
    assert render(spark, "{{#cero}}zero-is-truthy{{/cero}}") == "zero-is-truthy"
    assert render(spark, "{{#f}}no{{/f}}{{^f}}false-is-falsy{{/f}}") == "false-is-falsy"
    assert render(spark, "{{! comment }}ok") == "ok"


def test_nested_same_name_repeats(spark):
    # an inner section of the same name is found again in the parent scope
    out = render(spark, "{{#items}}[{{#items}}{{item}}{{/items}}]{{/items}}")
    assert out == "[ab][ab]"


def test_item_then_parent_lookup(spark):
    assert render(spark, "{{#items}}{{nombre}}/{{item}} {{/items}}") == "Ana &amp; &lt;Co&gt;/a Ana &amp; &lt;Co&gt;/b "


def test_parse_errors():
    with pytest.raises(TemplateError):
        parse("{{#a}}x")
    with pytest.raises(TemplateError):
        parse("{{/a}}")
    with pytest.raises(TemplateError):
        parse("{{> parcial}}")
    with pytest.raises(TemplateError):
        parse("{{abierto")


def test_text_is_text(spark):
    data = '{"l":"[urgente] x","o":"{a}","f":"false","vacia":[],"n":null,"d":{"a":{"b":"c"}}}'
    assert render(spark, "{{#l}}1{{/l}}{{#o}}2{{/o}}{{#f}}3{{/f}}{{^vacia}}4{{/vacia}}{{^n}}5{{/n}}{{d.a.b}}", data) == "12345c"
    assert render(spark, "{{&l}} {{&o}} {{&d}}", data) == "[urgente] x {a} {a={b=c}}"


def test_delimiters_and_images(spark):
    assert render(spark, "{{=<% %>=}}<% nombre %> {{nombre}}<%={{ }}=%>{{cero}}") == "Ana &amp; &lt;Co&gt; {{nombre}}0"
    assert render(spark, "{{{imagen_logo}}}", images={"logo": "iVBORw0KGgo="}) == "data:image/png;base64,iVBORw0KGgo="


def test_deep_data_and_numbers(spark):
    deep = '{"a":' * 60 + "1.50" + "}" * 60
    assert render(spark, "{{" + ".".join(["a"] * 60) + "}}", deep) == "1.5"
    assert render(spark, "{{x}} {{y}} {{z}}", '{"x":1e7,"y":12,"z":0.0001}') == "1.0E7 12 1.0E-4"
