"""HTML extraction: regions by ratio, smoothing and clusters; names as a prior."""

import os

import pytest

pytest.importorskip("pliego.llm")

import __spark_entry__ as entry
from pliego.llm import htmltext
from pliego.llm.htmltext import main_text, smooth, threshold

SF = "/root/testdata/sf0.01"
TEXT = " ".join("Prose of a page that goes on for a good while, as such texts do." for _ in range(27))
END = "A short end."
MENU = "<div><a href=a>Home</a> <a href=b>News of the day</a></div>"
FOOT = "<div>Copyright 2024 Example Corp. <a href=t>Terms of use</a></div>"
PLAIN = f"<body>{MENU}<div><h1>Title</h1><p>{TEXT}</p><p>{END}</p></div>{FOOT}"


@pytest.mark.parametrize("name", ["elementor-widget-container", "layout-sidebar-right", "search-page", "side-by-side", "sidebar", "widget", "related-content"])
def test_a_name_does_not_empty_a_page(name):
    assert main_text(f"<body><div class='{name}'><p>{TEXT}</p><p>{END}</p></div>") == f"{TEXT} {END}"
    assert main_text(f"<body>{MENU}<div id='{name}'><p>{TEXT}</p></div>{FOOT}") == TEXT


def test_names_are_a_prior():
    assert main_text(f"<div role=main class=page-with-header-ad><p>{TEXT}</p></div>") == TEXT
    assert main_text(f"<form><p>{TEXT}</p><p>{END}</p></form>") == f"{TEXT} {END}"
    article = f"<article><p>{TEXT}</p><blockquote class=comment-quote>Said by one.</blockquote></article>"
    assert main_text(article) == f"{TEXT} Said by one."
    for name in ("sidebar", "comment-list", "site-footer", "ad", "cookie-notice", "widget-area", "siteFooter", "comments"):
        assert main_text(f"{article}<div class='x {name}'><p>{TEXT} {TEXT}</p></div>") == f"{TEXT} Said by one."
    assert main_text(f"<div hidden><p>{TEXT}</p></div><p>{END}</p>") == END


def test_the_ratio_selects_regions_without_an_article():
    assert main_text(PLAIN) == f"Title {TEXT} {END}"
    cells = f"<table><tr><td>{MENU}</td><td><p>{TEXT}</p><p>{END}</p></td></tr></table>{FOOT}"
    assert main_text(cells) == f"{TEXT} {END}"
    notes = f"<div><p>{TEXT}</p></div><div>Of note.</div><div><p>{TEXT}</p></div>{FOOT}"
    assert main_text(notes) == f"{TEXT} Of note. {TEXT}"


@pytest.mark.parametrize("constant", [float("inf"), float("-inf"), 0.0, 1000.0])
def test_a_constant_threshold_gives_other_texts(monkeypatch, constant):
    article = f"<article><p>{TEXT}</p></article>{FOOT}"
    right = [main_text(PLAIN), main_text(article)]
    monkeypatch.setattr(htmltext, "threshold", lambda values: constant)
    assert [main_text(PLAIN), main_text(article)] != right and main_text(PLAIN) != right[0]


def test_smoothing_and_clusters():
    assert smooth([3.0]) == pytest.approx([3.0]) and smooth([2.0, 2.0, 2.0]) == pytest.approx([2.0, 2.0, 2.0])
    low, mid, high = smooth([0.0, 9.0, 0.0])
    assert low == high and low < mid < 9.0
    assert 1 < threshold([1.0, 1.2, 60.0, 80.0]) < 60 and 0 < threshold([5.0]) <= 5.0 and threshold([0.0, 0.0]) == 0.0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_the_registered_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = entry.queries()["op9_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, main_text(pages[r.page_id].html), len(r.text)) and r.text
