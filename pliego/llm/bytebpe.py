"""Byte-level BPE ids of whole texts by the tiktoken library, and the bytes back.

The ranks come from a local file, so nothing is fetched. A long text goes to the
library in parts cut only where the pre-splitting pattern always ends a match;
the ids are those of the uncut text, and the library's memory is bounded by a
part. Decoding joins the bytes of the ids; what bytes make no UTF-8 stays bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import arrow_batches, with_fields

PART_CHARS = 65536

# Places that no match of a byte-level pattern spans and none looks beyond: white
# space after something else, and an ASCII letter or digit before an ASCII sign of
# another class. A sign before a letter is no such place ('s is one match).
SAFE = re.compile(r"(?<=\S)(?=[ \t\r\n])|(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-/:-~])")


def rank_file() -> str:
    """Default place of the ranks; a parameter everywhere below."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def split_pattern() -> str:
    """Default pre-splitting pattern; a parameter everywhere below."""
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """The library's encoding on the ranks of a file (base64 token, rank a line),
    without special tokens: made once a Python worker."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """``text`` in order, in parts of ``size`` characters or up to the first safe
    place behind them. A text without such a place is one part."""
    at = 0
    while len(text) - at > size:
        place = SAFE.search(text, at + size)
        if place is None:
            break
        yield text[at : place.start()]
        at = place.start()
    yield text[at:]


def encode_text(text: str, path: str, pattern: str, size: int = PART_CHARS) -> list[int]:
    enc = encoder(path, pattern)
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for part in safe_parts(text, size) for i in enc.encode_ordinary(part)]


def decode_ids(ids: list[int], path: str, pattern: str) -> bytes | None:
    """The bytes of ``ids``, joined; None if one of them is null or in no rank."""
    try:
        return encoder(path, pattern).decode_bytes(ids)
    except (KeyError, OverflowError, TypeError):
        return None


def bpe_encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ``out``: the ids of the whole text, special tokens' strings
    being ordinary text.

    Null and empty texts have no ids (an empty array); bytes that are no UTF-8
    are read as U+FFFD. Rows and their number stay, an empty table gives no rows,
    a column named ``out`` is replaced.
    """
    path, pattern = path or rank_file(), pattern or split_pattern()
    arrow_batches(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c != out], F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bpe_text"))
    schema = with_fields(docs.drop("_bpe_text"), f"`{out}` array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode_text(t.as_py().decode("utf-8", "replace"), path, pattern) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def bpe_decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``rows`` with ``out`` (binary): the bytes of the ids, joined.

    A null array, and one with an id that is null or in no rank, decode to null;
    an empty one to no bytes. ``F.make_valid_utf8`` of it is the text, where a
    sequence of ids cuts a character.
    """
    path, pattern = path or rank_file(), pattern or split_pattern()
    arrow_batches(rows.sparkSession)
    rows = rows.select(*[c for c in rows.columns if c != out], F.col(ids).alias("_bpe_ids"))
    schema = with_fields(rows.drop("_bpe_ids"), f"`{out}` binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = (v.as_py() for v in b.column(b.num_columns - 1))
            found = [None if v is None else decode_ids(v, path, pattern) for v in lists]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def bpe_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """A row per document: doc_id, n_tokens, and SHA-256 of its ids in decimal,
    joined by a space, and of the bytes that these ids decode to."""
    ids = bpe_encode(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text", path=path).drop("_text")
    both = bpe_decode(ids, path=path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
