"""RS6-RS8 context flattening and RN7 the PDF context.

The PDF path binds a *flattened* context: objects are walked and every
leaf is put under its own name (the parent path is dropped), so a repeated
leaf name keeps the value that comes last in document order; a list becomes
a list of maps, each item flattened the same way (a scalar item becomes
``{list name: text}``, a nested list ``{list name: [...]}``). Null leaves
print as ``''`` (RS6) or ``'null'`` (RS8, the JSON-node overload).

A data node is one value of one row, so the walk is a per-row step, to any
depth, in an Arrow-batched UDF: no shuffle.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import strict_base64
from .jsontext import flatten, load


def _flat(text: str | None, null_text: str) -> dict | None:
    if text is None:
        return None
    # A list is given as its JSON text, the leaves inside it as strings.
    return {k: json.dumps(v, ensure_ascii=False, separators=(",", ":")) if isinstance(v, list) else str(v) for k, v in flatten(load(text), null_text).items()}


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _flat_objects(data: pd.Series) -> pd.Series:
    return data.map(lambda t: _flat(t, ""))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _flat_nodes(data: pd.Series) -> pd.Series:
    return data.map(lambda t: _flat(t, "null"))


def flatten_context(data, null_text: str = "") -> Column:
    """RS6 / RS7: map<string,string> leaf name -> text (lists as JSON lists of
    flattened maps); the last leaf of a name in document order wins."""
    d = F.col(data) if isinstance(data, str) else data
    return _flat_nodes(d) if null_text == "null" else _flat_objects(d)


def flatten_context_json(data) -> Column:
    """RS8: the JsonNode overload -- a null leaf prints ``null``."""
    return flatten_context(data, null_text="null")


def pdf_images(images) -> Column:
    """RN7: decoded images under ``image_pr_<name>`` (map<string,binary>)."""
    i = F.col(images) if isinstance(images, str) else images
    return F.map_from_entries(F.transform(
        F.map_entries(i), lambda e: F.struct(F.concat(F.lit("image_pr_"), e["key"]), strict_base64(e["value"]))
    ))


def pdf_context(data, images) -> Column:
    """RN7: struct<context map<string,string>, images map<string,binary>>."""
    return F.struct(flatten_context(data).alias("context"), pdf_images(images).alias("images"))


def context_rows(df: DataFrame, keys: list[str], data: str = "data", null_text: str = "") -> DataFrame:
    """One row per (request, leaf name) with the winning value."""
    rows = df.select(*keys, flatten_context(F.col(data), null_text).alias("m"))
    return rows.select(*keys, F.explode("m").alias("name", "value"))
