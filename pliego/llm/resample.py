"""Importance resampling towards a target distribution by hashed word runs.

The pre-tokeniser of the tokenizers library (an untrained Split by a regular
expression) gives the words of a lower-cased text with their offsets. Windows
over these offsets are the features; their CRC-32 picks a bucket. Bucket counts
of all documents and of all target texts give each bucket a gain; a document's
weight is the sum of its features' gains, and Gumbel noise, a hash of the
document's id, turns the highest scores into a sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pliego.llm.common import arrow_batches, cut, whole_row, with_fields

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
PART_BYTES = 65536
# Buckets of words remembered by a Python worker.
MEMO = 1 << 18


def splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(WORD), behavior="removed", invert=True)


def parts(low: bytes, size: int = PART_BYTES) -> Iterator[bytes]:
    """``low`` in parts of ``size`` bytes or up to the next space or line end
    behind them, which no word holds."""
    at = 0
    while len(low) - at > size:
        ends = [e for e in (low.find(b" ", at + size), low.find(b"\n", at + size)) if e >= 0]
        if not ends:
            break
        yield low[at : min(ends)]
        at = min(ends)
    yield low[at:]


class Hasher:
    """Words and feature buckets of texts; a word's bucket is remembered."""

    def __init__(self, n: int, buckets: int):
        self.n, self.buckets, self.split, self.memo = n, buckets, splitter(), {}

    def bucket(self, feature: str) -> int:
        return zlib.crc32(feature.encode()) % self.buckets

    def known(self, word: str) -> int:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[word] = self.bucket(word)
        return found

    def features(self, text: bytes | None) -> tuple[int, np.ndarray]:
        """(number of words, bucket of each feature): all runs of 1 to n words."""
        found, n_words, last = [], 0, []
        for part in parts((text or b"").lower()):  # bytes.lower knows A-Z alone
            low = part.decode("utf-8", "replace")
            spans = self.split.pre_tokenize_str(low)
            n_words += len(spans)
            found += [self.known(word) for word, _ in spans]
            if self.n > 1:
                words = last + [low[s:e] for _, (s, e) in spans]  # the last words of the part before lead on
                for k in range(2, self.n + 1):
                    new = max(0, len(last) - k + 1)
                    found += [self.bucket(" ".join(words[i : i + k])) for i in range(new, len(words) - k + 1)]
                last = words[1 - self.n :]
        return n_words, np.array(found, dtype=np.int32)


def bucket_rows(texts: DataFrame, text: str, n: int, buckets: int) -> DataFrame:
    """``texts`` without ``text``, with _words (long) and _features (array<int>, a
    bucket per feature). A null text has none; bytes that are no UTF-8 are U+FFFD."""
    arrow_batches(texts.sparkSession)
    kept = [c for c in texts.columns if c != text]
    schema = with_fields(texts.select(*kept), "_words long, _features array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Hasher(n, buckets)
        for b in batches:
            each = [own.features(t.as_py()) for t in b.column(b.num_columns - 1)]
            ends = np.cumsum([0, *(len(v) for _, v in each)], dtype=np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *(v for _, v in each)])
            cols = [pa.array([w for w, _ in each], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=schema.names)

    return texts.select(*kept, F.col(text).cast("binary").alias("_bytes")).mapInArrow(run, schema)


def histogram(features: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket. A task adds up its own rows and hands on at most
    a row per bucket; the driver gets that many counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["bucket", "n"])

    counts = features.select("_features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))): how much more often
    the target holds it, smoothed by one feature a bucket."""
    s_all, t_all, size = float(source.sum()), float(target.sum()), len(source)
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in pairs], dtype=np.int64)


def weigh(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``rows`` with _n (features) and _weight (their gains' sum) in place of _features."""
    kept = [c for c in rows.columns if c != "_features"]
    schema = with_fields(rows.select(*kept), "_n long, _weight long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            ends = np.cumsum([0, *lists.value_lengths().to_numpy(zero_copy_only=False)])
            run_sum = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)])])
            cols = [pa.array(np.diff(ends), pa.int64()), pa.array(np.diff(run_sum[ends]), pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=schema.names)

    return rows.select(*kept, "_features").mapInArrow(run, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the id; a null id hashes as no text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, percent: float, min_words: int) -> DataFrame:
    """``rows`` (_id, _u, _words, _score) with rank: 1, 2, 3 ... for the drawn, null for the rest.

    Rows below a quantile that lies under the draw by more than its own error
    can't be drawn; the others are dealt out by ranges of (score, id), written,
    and numbered range by range from the ranges' sizes. A hash of _u tells equal
    rows apart, so that no group of them is bound to one range.
    """
    able = F.col("_words") >= min_words
    n, low = rows.filter(able).agg(F.count(F.lit(1)), F.percentile_approx("_score", max(0.0, 0.99 - percent / 100), 1000)).first()
    draw = math.floor(percent * n / 100)
    if not draw:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    order = [F.col("_score").desc(), F.col("_id").asc_nulls_last(), F.xxhash64("_u")]
    for first in (able & (F.col("_score") >= low), able):
        dealt = cut(rows.filter(first).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
        if dealt.count() >= draw:
            break
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    firsts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = dealt.withColumn("_place", place).join(firsts, "_part").withColumn("rank", F.col("_first") + F.col("_place"))
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")).cast("long"))
    rest = rows.filter(~first).withColumn("rank", F.lit(None).cast("long"))
    return numbered.select(*rest.columns).unionByName(rest)


def scored_rows(rows: DataFrame, target: DataFrame, n: int, buckets: int, percent: float, min_words: int, seed: int) -> DataFrame:
    """``rows`` (_id, _u, _text) as _id, _u, _words, _n, _weight, _score and rank."""
    own = cut(bucket_rows(rows, "_text", n, buckets), "features")
    gain = gains(histogram(own, buckets), histogram(bucket_rows(target, "_text", n, buckets), buckets))
    scored = weigh(own, gain).withColumn("_score", F.col("_weight") + noise(F.col("_id"), seed))
    return ranked(cut(scored, "scores"), percent, min_words)


def importance_ranks(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text",
    n: int = 1, buckets: int = BUCKETS, percent: float = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """A row per document: doc_id, n_features, weight, score and rank (null: not drawn).

    A null or empty text has no features and weight 0; repeated rows are rows of
    their own and, equal in score and id, take neighbouring ranks; a null id
    comes after the others; an empty table gives no rows, an empty target makes
    every bucket one that the target never holds. Other columns don't matter.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.monotonically_increasing_id().alias("_u"), F.col(text).alias("_text"))
    found = scored_rows(rows, target.select(F.col(target_text).alias("_text")), n, buckets, percent, min_words, seed)
    return found.select(F.col("_id").alias(doc_id), F.col("_n").alias("n_features"), F.col("_weight").alias("weight"), F.col("_score").alias("score"), "rank")


def resampled_documents(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text",
    n: int = 1, buckets: int = BUCKETS, percent: float = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """The drawn rows of ``docs``, its columns alone. Rows are written with a number
    of their own, so that each of several equal rows is drawn or not."""
    boxed = cut(docs.select(whole_row(), F.monotonically_increasing_id().alias("_u")), "rows")
    rows = boxed.select(F.col(f"_row.{doc_id}").alias("_id"), "_u", F.col(f"_row.{text}").alias("_text"))
    found = scored_rows(rows, target.select(F.col(target_text).alias("_text")), n, buckets, percent, min_words, seed)
    return boxed.join(found.filter(F.col("rank").isNotNull()).select("_u"), "_u").select("_row.*")
