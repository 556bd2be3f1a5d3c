"""K-d tree partitioning of documents into shards of equal bytes.

A node of the tree is a range of shards. It is split along the metadata
dimension in which its documents spread widest, at the weighted quantile that
gives each side its shards' part of the bytes (the weighted median for an even
number of shards). Quantiles come from histograms that executors sum and that
are refined around the cut; the driver sees counts of buckets, never rows.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import KEY, cut, gapless, row_key, whole_row

BITS = 12  # of the sort key, seen by one pass over the rows
ROW = "_row_number_of_sharding"
COORDINATE, TIE = 31, 32  # bits of a coordinate, and of the hashes that order equal ones


def metadata(docs: DataFrame, text: str = "text", names: tuple[str, ...] = ("lang",)) -> dict[str, Column]:
    """The dimensions of a document: the log of its size, and the columns ``names``
    where they are there, each value placed by its hash, null as 0. Columns in
    which copies of a text differ (id, source) are left out by default, so that
    copies lie side by side and share a shard unless a cut falls on them."""
    out = {"size": F.log2(F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8.0))}
    return out | {c: F.when(F.col(c).isNotNull(), F.pmod(F.xxhash64(c), F.lit(1 << 20)) + 1).cast("double") for c in names if c in docs.columns}


def _split(parts: DataFrame, shards: int, dims: int, slack: float) -> DataFrame:
    """``parts`` (_q: array of coordinates, _tie, size) with column ``shard``."""
    spark = parts.sparkSession
    ranges = {0: shards}  # first shard of a node -> its number of shards
    out = parts.withColumn("shard", F.lit(0))
    while any(n > 1 for n in ranges.values()):
        spread = [(F.max(F.col("_q")[d]) - F.min(F.col("_q")[d])).alias(f"w{d}") for d in range(dims)]
        stats = {r["shard"]: r for r in out.groupBy("shard").agg(F.sum("size").alias("bytes"), *spread).collect()}  # a row a node
        nodes = {}
        for node, n in ranges.items():
            if n > 1 and node in stats:
                r = stats[node]
                nodes[node] = {"n": n, "dim": max(range(dims), key=lambda d: r[f"w{d}"]), "want": r["bytes"] * (n // 2) / n, "below": 0, "prefix": 0, "at": None, "slack": r["bytes"] * slack / n}
        if not nodes:
            break
        dim = _values(spark, "shard int, dim int", [(k, v["dim"]) for k, v in nodes.items()])
        keyed = out.join(F.broadcast(dim), "shard").select("shard", "size", _key(F.col("dim")).alias("key"))
        shift = COORDINATE + TIE
        while shift and any(v["at"] is None for v in nodes.values()):
            step = min(BITS, shift)
            shift -= step
            seen = _values(spark, "shard int, prefix long", [(k, v["prefix"]) for k, v in nodes.items() if v["at"] is None])
            inside = keyed.join(F.broadcast(seen), "shard").filter(F.shiftright("key", shift + step) == F.col("prefix"))
            bucket = F.shiftright("key", shift).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
            hist: dict[int, list] = {}
            for r in inside.groupBy("shard", bucket.alias("bucket")).agg(F.sum("size").alias("bytes")).collect():  # 4096 a node at most
                hist.setdefault(r["shard"], []).append((r["bucket"], r["bytes"]))
            for node, found in hist.items():
                v = nodes[node]
                for b, size in sorted(found):
                    if v["below"] + size < v["want"]:
                        v["below"] += size
                        continue
                    first = (v["prefix"] << step) + b
                    if size <= v["slack"] or not shift:  # cut on the nearer side of this bucket
                        after = v["below"] + size - v["want"] < v["want"] - v["below"]
                        v["at"] = (first + after) << shift
                    else:
                        v["prefix"] = first
                    break
        cuts = _values(spark, "shard int, dim int, at long, n int", [(k, v["dim"], v["at"], v["n"] // 2) for k, v in nodes.items()])
        right = F.coalesce((_key(F.col("dim")) >= F.col("at")).cast("int") * F.col("n"), F.lit(0))
        out = out.join(F.broadcast(cuts), "shard", "left").withColumn("shard", F.col("shard") + right).drop("dim", "at", "n")
        ranges = {k: v for node, n in ranges.items() for k, v in ([(node, n // 2), (node + n // 2, n - n // 2)] if n > 1 else [(node, n)])}
    return out


def _key(dim: Column) -> Column:
    return F.shiftleft(F.col("_q")[dim], TIE).bitwiseOR(F.col("_tie"))


def _values(spark, ddl: str, rows: list[tuple]) -> DataFrame:
    """A table of the nodes of one level: at most as many rows as shards."""
    names, kinds = zip(*(c.split() for c in ddl.split(", ")), strict=True)
    body = ", ".join("(" + ", ".join(f"CAST({v} AS {k})" for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def kd_shards(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id", dims: dict[str, Column] | None = None, slack: float = 0.002, row: Column | None = None) -> DataFrame:
    """Digest of the sharded documents: doc_id, size, text_crc32, shard, slot, _u.

    Sizes are the text's UTF-8 bytes (null: none) plus 8. Shards differ by the
    documents at the cuts and by ``slack`` of a shard at most. Equal coordinates
    are ordered by a hash of the text, then of the row and its number ``_u``
    (``row``, by default given as the rows are read), so ties, hot values and
    repeated rows are split too, and a group of copies only where a cut falls on
    it. Null names count as a value of their own; an empty table gives an empty
    one; with fewer documents than shards some shards are empty.
    """
    dims = dims or metadata(docs, text)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)
    crc = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    values = [F.coalesce(c, F.lit(0.0)).cast("double") for c in dims.values()]
    number = (F.monotonically_increasing_id() if row is None else row).alias("_u")
    raw = cut(docs.select(F.col(doc_id).alias("_id"), size.alias("size"), crc.alias("text_crc32"), F.array(*values).alias("_v"), F.xxhash64(text).alias("_same"), *row_key(doc_id, text), number), "metadata")
    n = len(dims)
    ends = raw.agg(*[f(F.col("_v")[d]) for d in range(n) for f in (F.min, F.max)]).first()
    top = float((1 << COORDINATE) - 1)
    scaled = [F.lit(0).cast("long") if ends[2 * d] is None or ends[2 * d] == ends[2 * d + 1] else ((F.col("_v")[d] - F.lit(ends[2 * d])) / F.lit(ends[2 * d + 1] - ends[2 * d]) * F.lit(top)).cast("long") for d in range(n)]
    half = (1 << TIE // 2) - 1
    tie = F.shiftleft(F.col("_same").bitwiseAND(F.lit(half).cast("long")), TIE // 2).bitwiseOR(F.xxhash64("_k1", "_u").bitwiseAND(F.lit(half).cast("long")))
    parts = raw.select("_id", "size", "text_crc32", F.array(*scaled).alias("_q"), tie.alias("_tie"), *KEY, "_u")
    done = cut(_split(parts, shards, n, slack).select("_id", "size", "text_crc32", "shard", *KEY, "_u"), "sharded")
    return gapless(done, "shard", [*KEY, "_u"], "slot").drop(*KEY).withColumnRenamed("_id", doc_id)


def shard_documents(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard``; write it with partitionBy("shard"). Rows are written
    with a number of their own, by which each finds its shard."""
    boxed = cut(docs.drop("shard").select(whole_row(), F.monotonically_increasing_id().alias("_n")), "rows")
    dims = metadata(boxed.select("_row.*"), text)
    found = kd_shards(boxed.select("_row.*", F.col("_n").alias(ROW)), shards, text, doc_id, dims, row=F.col(ROW)).select(F.col("_u").alias("_n"), "shard")
    return boxed.join(found, "_n").select("_row.*", "shard")
