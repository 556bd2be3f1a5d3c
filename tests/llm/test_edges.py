"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing column names, for every operator."""

import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("pliego.llm")

from pliego.llm.covertree import embedding_dedup, embedding_links
from pliego.llm.htmltext import extract_text
from pliego.llm.linededup import line_dedup
from pliego.llm.mixing import mix, mixed_documents
from pliego.llm.packing import pack
from pliego.llm.quality import quality_filter, quality_verdicts
from pliego.llm.sharding import kd_shards, shard_documents
from pliego.llm.simhash import simhash_components, simhash_dedup
from pliego.llm.toxicity import toxicity
from pliego.llm.urlrules import filter_urls, judge_urls

LONG = " ".join(f"w{i} x{i % 97} y{i % 13}" for i in range(40_000))
GOOD = " ".join(f"word{i}" for i in range(80))
DDL = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, _row string, h int, n_lines int, rate double, shard string, _text int, fp string, _lines int"
ROWS = [
    (1, GOOD, "en", "a"), (1, GOOD, "en", "a"), (2, None, None, None), (None, "short text here", "de", None),
    (4, "", "en", "b"), (5, LONG, "fr", "a"), (6, GOOD, "en", "b"), (None, None, None, "a"), (7, " \t\n\x0b ", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, la, s, len(t) if t else None, "k", "r", 1, 2, 0.5, "s", 3, "f", 4) for i, t, la, s in ROWS]
    return spark.createDataFrame(rows, DDL).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")


def test_simhash(docs, none):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash_components(docs).collect()}
    assert simhash_components(docs).count() == len(ROWS)
    assert got[(2, "0" * 16)] == got[(4, "0" * 16)] == got[(7, "0" * 16)] == got[(None, "0" * 16)] == 2
    assert {v for (i, _), v in got.items() if i in (1, 6)} == {1}
    kept = simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5]
    assert simhash_components(none).count() == simhash_dedup(none).count() == 0


def test_quality(docs, none):
    rows = quality_verdicts(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[1].kept and by[1].n_words == 80 and not by[1].base_failed
    assert by[2].n_words == by[4].n_words == by[7].n_words == 0 and by[2].base_failed and not by[2].kept
    assert by[5].n_words == 120_000 and by[5].n_repeat_words == 0
    kept = quality_filter(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 5, 6]
    assert quality_verdicts(none).count() == quality_filter(none).count() == 0


def test_line_dedup(spark, docs, none):
    out = line_dedup(docs)
    assert out.count() == len(ROWS) and set(docs.columns) <= set(out.columns)
    assert {r.text for r in out.filter("doc_id = 2").collect()} == {None}
    assert line_dedup(none).count() == 0
    rows = [(i, f"own line number {'x' * i}\nThe  Same line 1 here\nlast", f"s{i}") for i in range(1, 8)] + [(None, "the same LINE 2 here", None)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].text == rows[0][1] and got[1].n_removed == 0
    assert all(got[i].text == f"own line number {'x' * i}\nlast" and got[i].n_removed == 1 and got[i].n_lines == 3 for i in range(2, 8))
    assert got[None].text == ""


def test_packing(docs, none):
    rows = pack(docs).collect()
    assert sum(r.piece == 0 for r in rows) == len(ROWS)
    assert {(r.length, r.ids_crc32) for r in rows if r.doc_id in (2, 4)} == {(1, zlib.crc32(b"\0\0\0\0"))}
    assert pack(none).count() == 0


def test_sharding(docs, none):
    rows = kd_shards(docs, 24).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.shard < 24 for r in rows)
    assert {r.text_crc32 for r in rows if r.doc_id == 2} == {0} and {r.size for r in rows if r.doc_id == 2} == {8}
    out = shard_documents(docs, 3)
    assert out.count() == len(ROWS) and dict(out.dtypes)["shard"] == "int"
    assert kd_shards(none, 24).count() == 0


def test_mixing(docs, none, labels):
    rows = mix(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(r.rate >= 0 and r.copies >= 0 for r in rows)
    assert {r.tokens for r in rows if r.doc_id in (2, 4, 7)} == {0}
    assert mixed_documents(docs, labels).columns == docs.columns
    assert mix(none, labels).count() == mixed_documents(none, labels.filter("false")).count() == 0


def test_toxicity(docs, none, labels):
    rows = toxicity(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)
    assert toxicity(docs, labels.filter("false")).count() == len(ROWS)
    assert toxicity(none, labels).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.b.com/x", "r"), (1, "http://A.b.com/x", "r"), (2, None, "r"), (3, "", "r"), (4, "http://" + "a." * 50_000 + "net/es/", "r")], "page_id long, url string, rule string")
    got = judge_urls(pages).collect()
    assert len(got) == 5 and {(r.host, r.path, r.rule, r.verdict) for r in got if r.page_id == 1} == {("a.b.com", "/x", "com/", "allow")}
    assert {(r.host, r.path, r.rule, r.verdict) for r in got if r.page_id in (2, 3)} == {("", "", None, "allow")}
    assert {r.verdict for r in got if r.page_id == 4} == {"block"}
    assert filter_urls(pages).columns == pages.columns and filter_urls(pages).count() == 4
    assert judge_urls(pages.filter("false")).count() == 0


def test_html(spark):
    long = "<div>" * 3000 + "<p>deep " + "word " * 50_000
    pages = spark.createDataFrame([(1, "u", None, 1), (2, "u", "", 1), (3, None, "<p>a &amp;\n b", 1), (3, None, "<p>a &amp;\n b", 1), (4, "u", long, 1), (5, "u", "<script>x</script><nav>y</nav>", 1)], "page_id long, url string, html string, _html int")
    got = extract_text(pages).collect()
    assert len(got) == 6 and {(r.text, r.n_chars) for r in got if r.page_id in (1, 2, 5)} == {("", 0)}
    assert [r.text for r in got if r.page_id == 3] == ["a & b"] * 2
    assert {r.n_chars for r in got if r.page_id == 4} == {4 + 5 * 50_000}
    assert extract_text(pages.filter("false")).count() == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e300, 1e299])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_links(vectors).collect()]
    assert len(got) == len(rows)
    alone = {(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)} | {(None, 0, None, False)}
    assert set(got) == alone | {(1, 3, 1, True), (2, 3, 1, False), (10, 3, 1, False)}
    assert embedding_links(vectors.filter("false")).count() == 0
    assert embedding_dedup(vectors).filter(F.col("vec_id") == 2).count() == 0
