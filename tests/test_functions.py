"""Scalar functions against the golden values of the reference's tests and
samples (FIXTURES F4, F5, F9, F10)."""

from pyspark.sql import functions as F

from pliego import functions as fn
from pliego.operators.reshape import extract_images

from .conftest import one_col


def apply(spark, f, values):
    df = one_col(spark, values).select(f(F.col("v")).alias("r"))
    return [r["r"] for r in df.collect()]


def test_path_after_colon_f5(spark):
    ins = [
        "s3@almacen.ejemplo.dev:2.0/equipo/cliente_uno/plantillas/10_112.odt",
        "s3@bucket:templates/plantilla.docx",
        "s3@bucket:plantilla.docx",
        "s3@storage.example.com:v1/company/project/docs/report.pdf",
        "plantilla.docx",
        "",
        None,
    ]
    assert apply(spark, fn.path_after_colon, ins) == [
        "2.0/equipo/cliente_uno/plantillas/10_112.odt",
        "templates/plantilla.docx",
        "plantilla.docx",
        "v1/company/project/docs/report.pdf",
        "plantilla.docx",
        "",
        "",
    ]


def test_template_path_check_f4(spark):
    ok = ["plantilla.docx", "templates/invoice.docx", "s3@b:k/f.odt", "fs@/abs/f.docx", "http@https://h/f.odt"]
    bad = ["../etc/passwd", "/etc/passwd", "C:\\Windows\\System32\\config", None, "   ", "fs@/a/../b"]
    assert apply(spark, fn.path_is_unsafe, ok) == [False] * len(ok)
    assert apply(spark, fn.path_is_unsafe, bad) == [True] * len(bad)
    assert apply(spark, fn.path_error_subject, [None, "  ", "x"]) == ["null or empty", "null or empty", "x"]


def test_image_mime_f9(spark):
    ins = ["iVBORw0KGgo=", "/9j/4AAQ", "R0lGODlh", "UklGRg==", "!!notbase64", "AAAA"]
    assert apply(spark, fn.sniff_image_mime, ins) == [
        "image/png", "image/jpeg", "image/gif", "image/webp", "image/png", "image/png",
    ]
    assert apply(spark, fn.image_data_uri, [None]) == ["data:image/png;base64,"]
    assert apply(spark, fn.strict_base64, ["iVBORw", "iVBOR", "a b="]) [1:] == [None, None]


def test_redaction_f10(spark):
    assert apply(spark, fn.sanitize_path, ["/a/b/c.pdf", "a/b/", "", "/"]) == ["c.pdf", "b", "[empty]", ""]
    assert apply(spark, fn.sanitize_s3_uri, ["s3://b/k/f.pdf", "s3@h:k/f.odt", "s3://b"]) == [
        "s3://****/f.pdf", "f.odt", "s3://****/[empty]",
    ]
    assert apply(spark, fn.sanitize_http_url, ["https://h/a/f.pdf?x=1", "http@https://h/f"]) == ["https://****/f.pdf", "f"]
    assert apply(spark, fn.sanitize_error_message, ["see https://host/a/b x", "see https://host", "10.0.0.1 down", None]) == [
        "see https:/.../b x", "see http://[REDACTED]", "[IP] down", "null",
    ]


def test_human_bytes_f10(spark):
    df = spark.createDataFrame([(1023,), (1536,), (1280,), (1048576,)], "n bigint")
    assert [r[0] for r in df.select(fn.human_bytes("n")).collect()] == ["1023 B", "1.5 KB", "1.3 KB", "1.0 MB"]


def test_sanitize_map_f10(spark):
    df = spark.createDataFrame([(None,), ({},), ({"a": "1", "b": "2", "c": "3"},)], "m map<string,string>")
    assert [r[0] for r in df.select(fn.sanitize_map("m")).collect()] == ["null", "{empty}", "{3 fields}"]


def test_formats_and_protocols(spark):
    assert apply(spark, fn.resolve_format, [None, " ", "HTML ", "txt", "xml"]) == ["pdf", "pdf", "html", "txt", "pdf"]
    assert apply(spark, fn.template_protocol, ["s3@b:k", "fs@/x", "http@x", "https@x", "ftp@x", "local"]) == [
        "s3@", "fs@", "http", "http", None, None,
    ]
    assert apply(spark, fn.strip_protocol, ["fs@/a", "http@http://h", "https@https://h"]) == ["/a", "http://h", "https://h"]
    assert apply(spark, fn.content_type, ["a.PDF", "b.htm", ".odt", "x.", "y.docx"]) == [
        "application/pdf", "text/html", "application/octet-stream", "application/octet-stream",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ]


def test_cache_key(spark):
    import hashlib

    u = "s3@h.dev:key"
    assert apply(spark, fn.cache_key, [u, "fs@/a/b.html"]) == [
        hashlib.md5(u.encode()).hexdigest() + ".dev:key",
        hashlib.md5(b"fs@/a/b.html").hexdigest() + ".html",
    ]


def test_template_file_name(spark):
    assert apply(spark, fn.template_file_name, ["", "s3@h:a/b/c.odt", "x\\y\\z.docx", "a/"]) == [
        "[unknown]", "c.odt", "z.docx", "a/",
    ]


def test_extract_images(spark):
    data = ['{"images":{"logo":"AAAA"}}', '{"images":"x"}', '{"images":{"a":{"b":1}}}', '{"x":1}']
    out = apply(spark, extract_images, data)
    assert out[0] == {"logo": "AAAA"} and out[1] == {} and out[2] == {} and out[3] == {}


def test_sortable_id_is_stable(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "k")], "ts string, k string")
    a = df.select(fn.sortable_id(F.col("ts").cast("timestamp"), F.col("k"))).first()[0]
    assert len(a) == 26 and a == df.select(fn.sortable_id(F.col("ts").cast("timestamp"), F.col("k"))).first()[0]
