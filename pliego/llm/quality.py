"""Quality rules: cross-document line frequency, after base checks of the text.
DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import BLANKS, KEY, cut, row_key, whole_row
from pliego.llm.textlines import drop_lines, line_rows, with_text

MIN_WORDS = 50
MAX_REPEAT = 50  # per cent of the words that may lie in repeated 3-word windows
MAX_DOCS = 10  # documents of a host that may share a line, and
MAX_SHARE = 0.001  # their share of the host's documents, whichever is more
MIN_LEFT = 0.2  # of its words must be left without lines above the limit
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ", -1), "")


def measures(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    base_failed of every whole text, computed within the row (no shuffle).

    A 3-word window counts as repeated where its 64-bit hash occurs again in
    the text; the words under repeated windows are counted once each.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    full = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    rows = docs.select(
        *keep,
        _words(t).alias("_w"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        full.alias("_full"),
    )
    # Arrays that a lambda reads are columns of an earlier select and used more
    # than once in the next, so Spark computes them once a row.
    n = F.size("_w")
    window = F.transform("_w", lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)))
    rows = rows.select(
        *keep, "word_chars", "n_symbols",
        n.cast("long").alias("n_words"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        F.slice(window, 1, F.greatest(n - 2, F.lit(0))).alias("_h"),
    )
    done = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    pairs = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.select(*keep, *done, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs).alias("_s"))
    again = F.transform("_s", lambda x, k: F.when((F.get("_s", k - 1)["h"] == x["h"]) | (F.get("_s", k + 1)["h"] == x["h"]), x["i"]))
    rows = rows.select(*keep, *done, F.sort_array(F.filter(again, lambda x: x.isNotNull())).alias("_p"))
    covered = F.transform("_p", lambda x, k: F.coalesce(F.least(F.lit(3), F.get("_p", k + 1) - x), F.lit(3)))
    covered = F.aggregate(covered, F.lit(0), lambda a, x: a + x)
    rows = rows.select(*keep, *done, F.coalesce(F.when(F.size("_p") > 0, covered), F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def frequent_lines(rows: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, h, first): lines of ``rows`` (host, h, t: hash of the whole text) in
    more distinct documents of a host than the limits allow. Exact copies are one
    document. ``first`` is the text that keeps the line: the smallest hash."""
    # rows -> (host, line, text) -> (host, line): each step combines map-side, so a
    # hot line or host is summed where it is read.
    distinct = rows.groupBy("host", "h", "t").agg(F.lit(1).alias("one"))
    counts = distinct.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs"), F.min("t").alias("first")).filter(F.col("docs") > max_docs)
    sizes = rows.select("host", "t").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    often = counts.join(cut(sizes, "hosts"), "host").filter(F.col("docs") > F.col("all") * max_share)
    return cut(often.select("host", "h", "first"), "frequent")


def _judge(docs: DataFrame, text: str, host: str, doc_id: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Verdicts (``keep``, keys, measures, words_left, kept) and removed lines (keys, pos)."""
    keys = row_key(doc_id, host, text)
    slim = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.col(text).alias("_text"), *keys)
    same = F.conv(F.substring(F.md5(F.coalesce("_text", F.lit(""))), 1, 15), 16, 10).cast("long")
    lines = slim.select(F.col("_host").alias("host"), same.alias("t"), "_text", *KEY)
    lines = cut(line_rows(lines, "_text", ["host", "t", *KEY], 1), "lines")
    above = lines.join(frequent_lines(lines), ["host", "h"]).filter(F.col("t") != F.col("first"))
    removed = cut(above.select(*KEY, "pos", "nw").distinct(), "removed")
    lost = cut(removed.groupBy(*KEY).agg(F.sum("nw").alias("_lost")), "lost")
    # Written: a filter on the verdict pushed below would compute the measures' arrays again for each use.
    out = cut(measures(slim, "_text", [*keep, *KEY]), "measures").join(lost, KEY, "left")
    out = out.withColumn("words_left", F.col("n_words") - F.coalesce("_lost", F.lit(0))).drop("_lost")
    kept = ~F.col("base_failed") & (F.col("words_left") >= MIN_LEFT * F.col("n_words"))
    return out.withColumn("kept", kept), removed


def quality_verdicts(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, words_left.

    Kept: not base_failed, and of its words at least MIN_LEFT stand in lines
    that are not above the limits of its host. A null text has no words and
    fails, a null host is a host of its own, repeated rows are one document and
    get the same verdict, an empty table gives none.
    """
    out, _ = _judge(docs, text, host, doc_id, [doc_id])
    return out.select(doc_id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


def quality_filter(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", n_chars: str = "n_chars") -> DataFrame:
    """The kept rows of ``docs``, all their columns, without the lines above the
    limits; ``n_chars``, where there is such a column, follows."""
    out, removed = _judge(docs, text, host, doc_id, [])
    kept = cut(out.filter("kept").select(*KEY).distinct(), "kept")
    rows = docs.select(whole_row(), F.col(text).alias("_text"), *row_key(doc_id, host, text)).join(kept, KEY)
    out = drop_lines(rows, removed)
    return out.select(with_text(F.col("_row"), docs.columns, text, n_chars).alias("_row")).select("_row.*")
