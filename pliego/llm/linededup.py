"""Line dedup by distinct-site spread.

Every line hash gets a HyperLogLog sketch of the sites it occurs on; sketches
merge by aggregation. A line whose estimate is near the threshold is counted
exactly. Lines on that many sites are boilerplate and go, save their first
occurrence, so a text that was merely copied around is not lost.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import KEY, cut, row_key, whole_row
from pliego.llm.textlines import drop_lines, line_rows, with_text

MIN_SITES = 5  # a line on so many sites is boilerplate
MIN_WORDS = 3  # shorter lines are left alone
LG_K = 10  # sketch size: 2 ** LG_K buckets, relative standard error 1.04 / sqrt(2 ** LG_K)


def spread_lines(rows: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Hashes (h) of the lines of ``rows`` (h, site; read from files) that occur on
    ``min_sites`` distinct sites or more."""
    margin = max(1.0, 4 * 1.04 / math.sqrt(2**lg_k) * min_sites)
    sketches = rows.groupBy("h").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
    spread = cut(sketches.select("h", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites - margin), "spread")
    near = spread.filter(F.abs(F.col("sites") - min_sites) <= margin).select("h")
    exact = rows.join(near, "h", "left_semi").select("h", "site").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("sites"))
    sure = spread.filter(F.col("sites") > min_sites + margin).select("h")
    return cut(sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("h")), "boilerplate")


def line_dedup(docs: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id", n_chars: str = "n_chars", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, lg_k: int = LG_K) -> DataFrame:
    """``docs`` without cross-site boilerplate lines, and n_lines, n_removed.

    Lines are compared normalised (lower case, white space, digits); those
    under ``min_words`` words are never removed. The first occurrence (smallest
    doc_id, rows without one last, then place in the text) of a line stays.
    No document goes, though its text may become empty; ``n_chars``, where
    there is such a column, follows. A null text stays null, a null site is a
    site of its own, repeated rows are one document, an empty table stays
    empty, other columns are passed through.
    """
    keys = row_key(doc_id, site, text)
    docs = docs.drop("n_lines", "n_removed")
    slim = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.col(text).alias("_text"), *keys)
    rows = cut(line_rows(slim, "_text", ["_id", "site", *KEY], min_words), "lines")
    boilerplate = spread_lines(rows, min_sites, lg_k)
    found = cut(rows.join(boilerplate, "h").select("h", F.struct(F.col("_id").isNull().alias("none"), "_id", *KEY, "pos").alias("at")), "found")
    first = cut(found.groupBy("h").agg(F.min("at").alias("first")), "first")
    gone = found.join(first, "h").filter(F.col("at") != F.col("first")).select("at._k1", "at._k2", "at.pos")
    out = drop_lines(docs.select(whole_row(), F.col(text).alias("_text"), *keys), gone)
    out = out.withColumn("_row", with_text(F.col("_row"), docs.columns, text, n_chars))
    return out.select("_row.*", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))
