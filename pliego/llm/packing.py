"""Pattern packing by non-negative least squares.

Documents become token pieces of at most ``capacity`` tokens. The histogram of
piece lengths has at most ``capacity`` entries however large the corpus is, so
the driver holds it: it enumerates patterns of one to three lengths that fill a
sequence exactly, fits their repeat counts to the histogram by non-negative
least squares, rounds them, and packs what is left by best fit on the
histogram. Each task then looks up where the n-th piece of its length goes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import KEY, arrow_batches, cut, gapless, row_key, with_fields

CAPACITY = 2048
END_ID = 0
SPECIAL = {"<|endoftext|>": 50256}
PIECE = "piece int, start long, length long, ids_crc32 long"


def vocabulary() -> str:
    """Default place of the byte-level BPE vocabulary; a parameter everywhere below."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """A document's ids, id 0 last. They equal those of the tokenizers library on
    the same vocabulary (a test compares them); this encoder is four times faster."""
    ids = _encoder(path).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, END_ID).astype("<u4")


def pieces(docs: DataFrame, text: str, keep: list[str], capacity: int = CAPACITY, path: str | None = None, ids: bool = False) -> DataFrame:
    """One row per piece: ``keep``, piece, start, length, ids_crc32, and with
    ``ids`` the token ids. A null text is empty: one piece, the end id alone.
    A document longer than ``capacity`` is cut into whole pieces; the first one
    takes the remainder."""
    arrow_batches(docs.sparkSession)
    path = path or vocabulary()
    ddl = PIECE + (", ids array<int>" if ids else "")
    schema = with_fields(docs.select(*keep), ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, piece, start, length, crc, tokens = [], [], [], [], [], []
            for i, t in enumerate(b.column(text)):
                own = token_ids(t.as_py(), path)
                first = len(own) % capacity or capacity
                bounds = [0, *range(first, len(own) + 1, capacity)]
                for k, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(own[s:e].tobytes()))
                    if ids:
                        tokens.append(own[s:e].astype(np.int32))
            take = pa.array(row, pa.int64())
            cols = [b.column(c).take(take) for c in keep]
            cols += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if ids:
                cols.append(pa.array(tokens, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def patterns(hist: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of one to three lengths present in ``hist`` that sum to the
    capacity, as rows of three lengths in falling order (0: none)."""
    there = np.flatnonzero(hist[: capacity + 1])
    there = there[there > 0]
    ok = np.zeros(capacity + 1, dtype=bool)
    ok[there] = True
    out = [np.array([[capacity, 0, 0]])] if ok[capacity] else []
    small = there[there <= capacity // 2]
    two = small[ok[capacity - small]]
    out.append(np.stack([capacity - two, two, np.zeros_like(two)], axis=1))
    for c in there[there <= capacity // 3]:
        b = there[(there >= c) & (there <= (capacity - c) // 2)]
        a = capacity - c - b
        b = b[ok[a]]
        out.append(np.stack([capacity - c - b, b, np.full_like(b, c)], axis=1))
    return np.concatenate(out)


def fit(hist: np.ndarray, rows: np.ndarray, capacity: int, rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts x of the patterns that minimise the squared
    residual of the histogram, lengths weighted by their share of a sequence;
    accelerated projected gradient on the sparse pattern matrix."""
    if not len(rows):
        return np.zeros(0)
    weight = np.maximum(np.arange(capacity + 1) / capacity, 0.1)
    weight[0] = 0
    want = hist * weight

    def forward(x: np.ndarray) -> np.ndarray:
        return weight * sum(np.bincount(rows[:, k], weights=x, minlength=capacity + 1) for k in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        r = r * weight
        return r[rows[:, 0]] + r[rows[:, 1]] + r[rows[:, 2]]

    v = np.ones(len(rows))
    for _ in range(12):
        v = back(forward(v / np.linalg.norm(v)))
    step = 1 / (1.05 * np.linalg.norm(v))
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - want))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence in falling order, repeats) that use up ``hist``
    (index: length, value: pieces) exactly."""
    left = hist.astype(np.int64).copy()
    rows = patterns(hist, capacity)
    x = fit(hist.astype(float), rows, capacity)
    out: list[tuple[tuple[int, ...], int]] = []
    for i in np.argsort(-x, kind="stable"):
        n = int(x[i] + 0.5)
        if n == 0:
            break
        lengths = [int(v) for v in rows[i] if v]
        n = min(n, *(int(left[v]) // lengths.count(v) for v in lengths))
        if n > 0:
            for v in lengths:
                left[v] -= n
            out.append((tuple(lengths), n))
    # Best fit, longest first, on counts: open[r] holds the sequences with r tokens free.
    free: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for v in range(capacity, 0, -1):
        n = int(left[v])
        while n:
            r = next((r for r in range(v, capacity) if free[r]), None)
            if r is None:
                each = capacity // v
                whole, rest = divmod(n, each)
                for m, k in ((each, whole), (rest, 1)):
                    if m and k:
                        key = (v,) * m
                        free[capacity - m * v][key] = free[capacity - m * v].get(key, 0) + k
                n = 0
            else:
                key, have = free[r].popitem()
                k = min(n, have)
                if have > k:
                    free[r][key] = have - k
                new = (*key, v)
                free[r - v][new] = free[r - v].get(new, 0) + k
                n -= k
    return out + [x for f in free for x in f.items()]


def places(sequences: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, times in a sequence, first sequence, offset) by
    length and rank: the pieces of a length, in rank order, fill these runs."""
    out, base = [], 0
    used: dict[int, int] = {}
    for lengths, n in sequences:
        at = 0
        for v in dict.fromkeys(lengths):
            m = lengths.count(v)
            out.append((v, used.get(v, 0), m, base, at))
            used[v] = used.get(v, 0) + m * n
            at += m * v
        base += n
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, path: str | None = None, ids: bool = False) -> DataFrame:
    """All documents, packed: one row per piece with doc_id, piece, start, length,
    ids_crc32, sequence_id and offset (and ids, if asked for).

    Nothing is dropped: null and empty texts are one piece of the end id,
    repeated rows are pieces of their own, a null doc_id stays null, an empty
    table gives no rows. Other columns of ``docs`` don't matter.
    """
    slim = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), *row_key(doc_id, text))
    each = cut(pieces(slim, "_text", ["_id", *KEY], capacity, path, ids), "pieces")
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for v, n in each.groupBy("length").count().collect():  # a row a length: capacity at most
        hist[v] = n
    runs = places(plan(hist, capacity))
    ranked = gapless(each, "length", [*KEY, "piece"], "rank")
    schema = with_fields(ranked, "sequence_id long, offset long")
    keys = (runs[:, 0] << 44) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = runs[np.searchsorted(keys, (v << 44) + rank, side="right") - 1]
            k = rank - at[:, 1]
            where = [pa.array(at[:, 3] + k // at[:, 2]), pa.array(at[:, 4] + k % at[:, 2] * v)]
            yield pa.RecordBatch.from_arrays([*b.columns, *where], names=schema.names)

    placed = ranked.mapInArrow(run, schema)
    return placed.select(F.col("_id").alias(doc_id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if ids else []))
