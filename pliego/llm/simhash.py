"""SimHash near-dedup over deletion-variant signatures.

A fingerprint is cut into d // 2 + 1 segments. Two fingerprints at d or fewer
differing bits have one segment in which they differ in at most one bit, so
with one bit of that segment masked they are equal there. Every fingerprint is
indexed under each segment with each of its bits masked (64 keys), equal keys
meet, and meetings are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import KEY, arrow_batches, cut, row_key, whole_row, with_fields
from pliego.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
# Fingerprints compared in one go; a larger key is dealt out in pairs of blocks.
BLOCK = 32768


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a whole text as an unsigned integer; null or wordless: 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \x20, \x09-\x0D only
    n = len(tokens)
    if n == 0:
        return 0
    line, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if n <= words:
        hashes = np.array([digest(line, HASH_SEED)], dtype=np.uint64)
    else:
        ends = list(accumulate(len(w) + 1 for w in tokens))
        starts = [0, *ends[: n - words]]
        hashes = np.fromiter((digest(line[s : e - 1], HASH_SEED) for s, e in zip(starts, ends[words - 1 :], strict=True)), dtype=np.uint64, count=n - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """All columns but the text, and ``fp`` (long, the fingerprint's bits)."""
    arrow_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text]
    schema = with_fields(docs.select(*keep), "fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(text)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fp)], names=[*keep, "fp"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit."""
    n = max_bits // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _variants(fps: DataFrame, max_bits: int) -> DataFrame:
    """(key, fp): each segment with each of its bits masked, as one long that also
    holds the segment's number and the bit."""
    keys = []
    for s, (at, width) in enumerate(segments(max_bits)):
        value = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
        for p in range(width):
            # The masked value needs at most width bits; segments are narrower than 52.
            keys.append(value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << p))).bitwiseXOR(F.lit((at + p) << 52)))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _forest(fps: np.ndarray, max_bits: int) -> tuple[list, list]:
    """Edges (node, first of its tree) of the links among ``fps``: a breadth-first
    walk, so a dense group of k costs about k comparisons and k - 1 edges."""
    a, b, rest = [], [], fps
    while len(rest):
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= max_bits
            if near.any():
                found, rest = rest[near], rest[~near]
                a.append(found)
                b.append(np.full(len(found), root))
                front.extend(found)
    return a, b


def _meet(max_bits: int):
    """mapInArrow function: rows (key, fp) sorted by key and fp to verified edges."""

    def emit(a: list, b: list) -> pa.RecordBatch:
        a = np.concatenate(a) if a else np.empty(0, np.uint64)
        b = np.concatenate(b) if b else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.diff(key, prepend=key[:1] ^ 1))
        size = np.diff(at, append=len(key))
        two = at[size == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits
        a, b = [fp[two + 1][near]], [fp[two][near]]
        for i, n in zip(at[size > 2], size[size > 2], strict=True):
            more = _forest(fp[i : i + n], max_bits)
            a += more[0]
            b += more[1]
        return emit(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            last = int(np.searchsorted(keys, keys[-1]))  # the last key's rows may go on in the next batch
            if last:
                yield links(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
        if len(keys):
            yield links(keys, fps)

    return run


def near_edges(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b) edges whose components are those of all links at ``max_bits`` or fewer
    bits among the distinct fingerprints ``fps`` (one column fp, read from files).

    Keys with more than ``block`` fingerprints are dealt out as pairs of blocks,
    a task a pair, so no key is held whole by a task. Which keys can be that
    large follows from counts of plain segment values: a key joins two of them.
    """
    spark = fps.sparkSession
    cuts = segments(max_bits)
    values = fps.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << w) - 1)).alias("v")) for s, (at, w) in enumerate(cuts)])).alias("x")).select("x.*")
    heavy = cut(values.groupBy("s", "v").count().filter(F.col("count") > block // 2).select("s", "v"), "heavy")
    rows = _variants(fps, max_bits)
    pairs = None
    if not heavy.isEmpty():
        wide = None
        for s, (at, w) in enumerate(cuts):
            some = heavy.filter(F.col("s") == s).select(F.explode(F.array(*[F.col("v").bitwiseAND(F.lit(((1 << w) - 1) & ~(1 << p))).bitwiseXOR(F.lit((at + p) << 52)) for p in range(w)])).alias("key"))
            wide = some if wide is None else wide.unionByName(some)
        sizes = rows.join(cut(wide.distinct(), "wide"), "key", "left_semi").groupBy("key").count()
        sizes = cut(sizes.filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("n")), "sizes")
        hot = rows.join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("fp"), "n").cast("int"))
        hot = hot.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        # Each pair of blocks is a key of its own; both of its blocks hold it.
        pairs = hot.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp")
        rows = rows.join(sizes, "key", "left_anti")

    def met(some: DataFrame) -> DataFrame:
        return some.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_meet(max_bits), "a long, b long")

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    edges = met(rows)
    if pairs is not None:
        edges = edges.unionByName(met(pairs))
    out = cut(edges.distinct(), "links")
    arrow_batches(spark)
    return out


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id, root, _k1, _k2), one row per row of ``docs``.

    ``component_id`` is the smallest doc_id that links at ``max_bits`` or fewer
    bits reach. Null and wordless texts have fingerprint zero and link like any
    other. Repeated rows each get the same answer. A null doc_id links others
    but names no component; a component of such rows alone has a null id.
    ``root`` names the component too and is never null. An empty table gives an
    empty one. Extra columns don't matter.
    """
    slim = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), *row_key(doc_id, text))
    each = cut(with_fingerprint(slim, "_text", words), "fingerprints")
    fps = cut(each.groupBy("fp").agg(F.min("_id").alias("rep")), "distinct")
    labels = components(near_edges(fps.select("fp"), max_bits, block))
    linked = fps.join(labels, fps.fp == labels.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    linked = cut(linked, "linked")
    least = cut(linked.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = cut(linked.join(least, "root").select("fp", "component_id", "root"), "named")
    return each.join(named, "fp").select(F.col("_id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root", *KEY)


def simhash_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all their columns, one of each component: the one with
    the smallest doc_id, a row without one only where no other is there. Of
    repeated rows one stays."""
    found = simhash_components(docs, text, doc_id, words, max_bits)
    best = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), *KEY)).alias("best")
    keep = cut(found.groupBy("root").agg(best).select("best._k1", "best._k2"), "keep")
    return docs.select(whole_row(), *row_key(doc_id, text)).join(keep, KEY).dropDuplicates(KEY).select("_row.*")
