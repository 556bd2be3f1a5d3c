"""HTML extraction: parser events, text-to-tag ratio, smoothing and clustering.

The standard library's parser streams a page's events into lines (blocks of
text with the tags spent on them). A line's text-to-tag ratio is its unlinked
text by its tags, smoothed by a Gaussian along the lines of its container; a
two-means threshold parts content from the rest, a line of no text being there
always. A container whose ratios together reach the threshold is a content
region and goes as a whole, save its menus, lines of links below the threshold.
An article element is one container, and where one is content its fellows are. On
a page without, what stands before the last region and is no menu belongs to the
text too: leads, captions, notes.
Names are a prior: elements that by tag or class are menus, adverts, notices,
forms or comments are left out, but not where one holds most of a page's text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import arrow_batches, with_fields

SIGMA = 1.0  # of the Gaussian, in lines
PROSE = 80.0  # characters a tag beyond which a line is no more prose than prose
LINKED = 0.6  # of a line's characters inside links: more is a menu

# Elements whose text is never shown as text, or is a control.
SILENT = set("script style template noscript svg math head title iframe object canvas audio video select option textarea button datalist".split())
# Elements that surround an article.
AROUND = set("nav footer aside form menu dialog fieldset".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# A block start tag closes an open paragraph; list items, cells and rows close their like.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
# Words of a class, id or role that mark menus, notices, adverts and comments: where
# they are what the name is of ("site-footer"), or are followed by parts of a layout
# only ("comment-list", but not "comment-quote").
NOISE = set(
    "ad ads adv advert adverts advertisement advertisements banner banners sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice notices "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side rail header footer masthead pagination pager toolbar skip "
    "comment comments disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe signup login widget widgets "
    "contentinfo complementary search alert alertdialog tablist".split()
)
NOISE |= set("commentlist adsbygoogle advertising cookiebar topbar subnav sidenav siteheader sitefooter".split())
PARTS = set("list lists wrapper wrap area box block section thread container inner outer unit slot bar form item items panel top bottom left right".split())
UNLESS = {"has", "with", "no", "without", "not", "by", "and"}  # class="content has-sidebar"
TITLED = {"article", "post", "entry", "story", "content", "main"}  # class="entry-header" holds the title
IN_HEAD = set("title meta link style script base noscript template".split())
GENERIC = {"div", "section", "article", "main", "body", "html", ""}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
NARTICLE = {"article", "main"}


class _Node:
    """An element: the elements around it that are left out, its article, its container."""

    __slots__ = ("name", "parent", "out", "article", "box", "sure")

    def __init__(self, name: str, parent: _Node | None, noise: bool = False, sure: bool = False):
        self.name, self.parent, self.sure = name, parent, sure
        above = parent.out if parent else ()
        self.out: tuple[_Node, ...] = (*above, self) if noise else above
        article = parent.article if parent else None
        self.article: _Node | None = article or (self if name in NARTICLE else None)
        self.box: _Node = self.article or (self if name in GENERIC or not parent else parent.box)


class _Lines(HTMLParser):
    """Collects [text, tags, node] for each block of text outside silent elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = self.node = _Node("", None)
        self.lines: list[tuple[str, int, _Node, int]] = []
        self.parts: list[str] = []
        self.tags = self.silent = self.linked = 0
        self.open: Counter[str] = Counter()  # so that find() only walks to what is there

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.node, self.linked))
            self.tags = 0
        self.parts, self.linked = [], 0

    def close_to(self, node: _Node | None) -> None:
        """Leave all elements below ``node``."""
        while self.node is not node and self.node.parent:
            if self.node.name in SILENT:
                self.silent -= 1
            self.open[self.node.name] -= 1
            self.node = self.node.parent

    def find(self, names: set[str], stop: set[str]) -> _Node | None:
        n = self.node
        while n.parent and any(self.open[x] for x in names):
            if n.name in names:
                return n
            if n.name in stop:
                return None
            n = n.parent
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if self.open["head"] and tag not in IN_HEAD and (head := self.find({"head"}, set())):
            self.close_to(head.parent)
        if tag in BLOCKS or tag == "br":
            if tag in BLOCKS:
                self.flush()
                if open_p := self.find({"p"}, {"table", "td", "th", "button"}):
                    self.close_to(open_p.parent)
            else:
                self.parts.append(" ")
        if tag in CLOSES and (like := self.find(CLOSES[tag], HOLDS[tag])):
            self.close_to(like.parent)
        if tag in VOID:
            return
        self.node = _Node(tag, self.node, *self.outside(tag, attrs))
        self.open[tag] += 1
        if tag in SILENT:
            self.silent += 1

    def outside(self, tag: str, attrs: list) -> tuple[bool, bool]:
        """(is no part of an article, surely so: by its tag or hidden, not by its name)"""
        if tag not in ("html", "body") and any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
            return True, True
        if tag in AROUND:
            return True, tag != "form"  # some pages are one form from end to end
        if tag == "header":  # a page's header; an article's own one holds its title
            return self.find(NARTICLE, set()) is None, True
        if tag in ("html", "body", "main", "article") or tag not in BLOCKS and tag not in ("span", "ins"):
            return False, False
        names = [v for k, v in attrs if v and k in ("class", "id", "role")]
        return any(self.noisy(token) for v in names for token in v.split()), False

    def noisy(self, token: str) -> bool:
        words = [w.lower() for w in WORD.findall(token)]
        if not words or not UNLESS.isdisjoint(words):
            return False
        if words[-1] == "header" and (not TITLED.isdisjoint(words) or self.find(NARTICLE, set())):
            return False
        return words[-1] in NOISE or words[0] in NOISE and PARTS.issuperset(words[1:])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do, "/>" closes void elements only

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        # An inline element may be left open; its end tag doesn't reach beyond the block it is in.
        found = self.find({tag}, set() if tag in BLOCKS or tag in SILENT else BLOCKS)
        if found:
            self.close_to(found.parent)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len(data)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing, the kernel normalised at the ends."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        got = [(values[i + k], w) for k, w in zip(range(-reach, reach + 1), kernel, strict=True) if 0 <= i + k < len(values)]
        out.append(sum(v * w for v, w in got) / sum(w for _, w in got))
    return out


def threshold(values: list[float]) -> float:
    """Boundary of the two clusters (two-means on the line) of ``values`` and a 0,
    the line without text: never above the greatest value."""
    values = [0.0, *values]
    low, high = 0.0, max(values)
    for _ in range(30):
        mid = (low + high) / 2
        below, above = [v for v in values if v <= mid], [v for v in values if v > mid]
        if not above:
            return low
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _shown(lines: list[tuple]) -> list[tuple]:
    """The lines outside menus, notices, adverts and the like. An element that holds
    most of the unlinked text is none of these, whatever its name, unless an
    article stands beside it."""
    seen = [x for x in lines if not any(n.sure for n in x[2].out)]
    total = sum(len(x[0]) - x[3] for x in seen)
    inside: Counter[_Node] = Counter()
    for text, _, node, linked in seen:
        for n in node.out:
            inside[n] += len(text) - linked
    page = {n for n, size in inside.items() if 2 * size > total}
    if page:
        articles = {x[2].article for x in seen if x[2].article and page.isdisjoint(x[2].out)}
        if articles:
            page = set()
    return [x for x in seen if page.issuperset(x[2].out)]


def main_text(html: str | None) -> str:
    """The main text of a whole page, its blocks in page order joined by a space."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    lines = _shown(parser.lines)
    if not lines:
        return ""
    boxes: dict[_Node, list[int]] = {}
    for i, (_, _, node, _) in enumerate(lines):
        boxes.setdefault(node.box, []).append(i)
    ratio = [0.0] * len(lines)
    for own in boxes.values():
        raw = [min(PROSE, max(0, len(lines[i][0]) - lines[i][3]) / (lines[i][1] + 1)) for i in own]
        for i, v in zip(own, smooth(raw), strict=True):
            ratio[i] = v
    least = threshold(ratio)
    regions = {box for box, own in boxes.items() if sum(ratio[i] for i in own) >= least}
    if not regions:
        return ""
    last = max(max(boxes[box]) for box in regions)
    whole = any(box.article for box in regions)
    kept = []
    for i, (text, _, node, linked) in enumerate(lines):
        menu = ratio[i] < least and not node.article and linked > LINKED * len(text)
        if not menu and (node.box in regions or (node.article if whole else i < last)):
            kept.append(text)
    return " ".join(kept)


def extract_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all other columns but these results) with text and n_chars (code
    points). One row per row: null, empty and markup-only pages have an empty
    text; an empty table gives none. Pages stay whole, one in memory at a time."""
    keep = [c for c in (keep or pages.columns) if c not in (html, "text", "n_chars")]
    arrow_batches(pages.sparkSession)
    src = pages.select(F.struct(*keep).alias("_row"), F.col(html).alias("_html"))
    schema = with_fields(src.select("_row"), "text string, n_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(x.as_py()) for x in b.column("_html")]
            cols = [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("_row"), *cols], names=schema.names)

    return src.mapInArrow(run, schema).select("_row.*", "text", "n_chars")
