"""Lines of documents as rows, and documents without some of their lines.
Used by line dedup and the quality rules; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import KEY


def normal_lines(text: Column) -> Column:
    """Array of a text's \\n-split lines, normalised: lower case, runs of other
    white space as one space, trimmed, digits as 0. A null text is one empty line."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\x0B\\x0C\\r]+", " ")
    return F.transform(F.split(F.translate(flat, "123456789", "000000000"), "\n", -1), lambda x: F.trim(x))


def line_rows(docs: DataFrame, text: str, keep: list[str], min_words: int) -> DataFrame:
    """``keep``, pos (from 0), h (64-bit hash of the normalised line) and nw (its
    words), a row for each line of ``min_words`` or more words."""
    words = lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.translate(x, " ", "")) + 1)
    each = F.transform(normal_lines(F.col(text)), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("h"), words(x).alias("nw")))
    rows = docs.select(*keep, F.explode(each).alias("_line")).select(*keep, "_line.*")
    return rows.filter(F.col("nw") >= min_words)


def drop_lines(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """``rows`` (_row, _text, _k1, _k2) without the lines that ``removed`` (_k1, _k2,
    pos) names: _row, _text, _n_lines and _n_removed. An untouched text stays as
    it is, a null one null."""
    gone = removed.groupBy(*KEY).agg(F.collect_set("pos").alias("_gone"))
    rows = rows.join(gone, KEY, "left").withColumn("_lines", F.split(F.col("_text"), "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    rows = rows.withColumn("_left", F.when(F.col("_gone").isNotNull(), left))
    # _lines is used more than once, so Spark keeps it as a column and doesn't split anew for each line.
    new = F.array_join(F.transform("_left", lambda i: F.coalesce(F.get("_lines", i), F.element_at("_lines", 1))), "\n")
    return rows.select(
        "_row",
        F.when(F.col("_left").isNotNull(), new).otherwise(F.col("_text")).alias("_text"),
        F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).alias("_n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("_n_removed"),
    )


def with_text(row: Column, columns: list[str], text: str, n_chars: str) -> Column:
    """``row`` with ``_text`` as its text, and its length as ``n_chars`` where it has that column."""
    row = row.withField(text, F.col("_text"))
    return row.withField(n_chars, F.length("_text").cast("long")) if n_chars in columns else row
