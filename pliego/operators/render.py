"""Binding and rendering: RN1, RN6-RN10 and the renderer
registry (U1).

HTML and TXT bodies come from one Arrow-batched UDF over the request rows: it
binds the data node, parsed to any depth, to the row's own template content, so
neither the number, the size nor the name of templates is limited. PDF needs a
converter; without a registered one a request stays ``status =
'needs_converter'`` with a fully bound context (RN7) and no location.
"""

from __future__ import annotations

import time
from functools import lru_cache
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E
from ..functions import bad_image_payload, cache_key, has_protocol, image_data_uri, resolve_format
from . import mustache
from .jsontext import as_map, java_text, load

# The plain-text document layout.
RULE_WIDTH = 60
TEXT_TITLE = "PLAIN TEXT DOCUMENT GENERATOR"
CACHE_DIR = "/tmp/templates-cache"

RENDERERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_renderer(fmt: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """U1: plug a renderer for a format (e.g. an ODT/DOCX -> PDF converter
    written with ``mapInPandas``). ``fn`` receives the bound requests of its
    format, ``body`` and ``status`` among their columns, and returns them with
    ``body`` filled and ``status = 'rendered'``."""
    RENDERERS[fmt] = fn


def pending_formats() -> list[str]:
    """Formats whose documents wait for a converter."""
    return [f for f in ("pdf",) if f not in RENDERERS]


def route_format(file_type) -> Column:
    """RN9: null/blank/unknown -> pdf; trims, ignores case."""
    return resolve_format(file_type)


def html_context(data, images) -> Column:
    """RN1: data entries, then images as ``imagen_<name>`` data URIs
    (overwriting a clash, like Map.put)."""
    d = F.col(data) if isinstance(data, str) else data
    i = F.col(images) if isinstance(images, str) else images
    imgs = image_uris(i)
    base = F.coalesce(as_map(d), F.create_map().cast("map<string,string>"))
    return F.map_concat(base, F.coalesce(imgs, F.create_map().cast("map<string,string>")))


def text_template_path(path, cache_dir: str = CACHE_DIR) -> Column:
    """The path the TXT generator prints: a protocol URI is shown as its
    cache file (``<cache_dir>/<md5><ext>``), a local path as given."""
    p = F.col(path) if isinstance(path, str) else path
    return F.when(has_protocol(p), F.concat(F.lit(cache_dir + "/"), cache_key(p))).otherwise(p)


def _text_body(shown: str | None, data) -> str:
    lines = ["=" * RULE_WIDTH, TEXT_TITLE, "=" * RULE_WIDTH, "", f"Template: {'null' if shown is None else shown}", ""]
    if data is not None:
        rule = "-" * RULE_WIDTH
        lines += ["Data:", rule, *(f"{k:<20} : {java_text(v)}" for k, v in (data.items() if isinstance(data, dict) else ())), rule]
    return "\n".join(lines) + "\n"


@lru_cache(maxsize=256)
def _parsed(source: str) -> list | str:
    """A template's AST, or why it has none; a task remembers the last ones."""
    try:
        return mustache.parse(source)
    except mustache.TemplateError as e:
        return str(e)


@F.pandas_udf(T.StructType([T.StructField("body", T.StringType()), T.StructField("error", T.StringType()), T.StructField("micros", T.LongType())]))
def _render_udf(fmt: pd.Series, shown: pd.Series, content: pd.Series, data: pd.Series, images: pd.Series) -> pd.DataFrame:
    bodies, errors, micros = [], [], []
    for f, path, source, text, uris in zip(fmt, shown, content, data, images):
        body = error = None
        begin = time.perf_counter_ns()
        if f == "txt":
            body = _text_body(path, load(text))
        elif f == "html" and source is not None:
            nodes = _parsed(source)
            if isinstance(nodes, str):
                error = nodes
            else:
                node = load(text)
                context = dict(node) if isinstance(node, dict) else {}
                context.update(load(uris) or {})
                body = mustache.bind(nodes, context)
        bodies.append(body)
        errors.append(error)
        micros.append(None if body is None else (time.perf_counter_ns() - begin) // 1000)
    return pd.DataFrame({"body": bodies, "error": errors, "micros": pd.array(micros, dtype="Int64")})


@F.pandas_udf(T.StringType())
def template_error(content: pd.Series) -> pd.Series:
    """Why a template's content cannot be parsed (E8), NULL if it can."""
    return content.map(lambda s: mustache.template_error(s or ""))


def image_uris(images: Column) -> Column:
    """``imagen_<name>`` -> data URI of each image (RN2)."""
    return F.map_from_entries(
        F.transform(F.map_entries(images), lambda e: F.struct(F.concat(F.lit("imagen_"), e["key"]), image_data_uri(e["value"])))
    )


def rendered(fmt, path, content, data, images, cache_dir: str = CACHE_DIR) -> Column:
    """RN6 / RN8: struct<body, error, micros> of a request; ``micros`` is the time that
    its own body took (A7). HTML binds ``content``, the
    plain-text document prints the data and never reads a template; any other
    format, and HTML without content, has neither body nor error."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    html, text = c(fmt) == "html", c(fmt) == "txt"  # a task gets what its format reads
    uris = F.when(html, F.to_json(image_uris(c(images))))
    shown = F.when(text, text_template_path(path, cache_dir))
    return _render_udf(c(fmt), shown, F.when(html, c(content)), F.when(html | text, c(data)), uris)


def pdf_images_error(images) -> Column:
    """V5 (PDF): a NULL payload fails in the converter (E8), a payload that
    does not decode strictly is E7."""
    i = F.col(images) if isinstance(images, str) else images
    has_null = F.coalesce(F.exists(F.map_values(i), lambda v: v.isNull()), F.lit(False))
    return (
        F.when(has_null, E.error("E8", F.lit(E.E8_PROCESSING % "null")))
        .when(bad_image_payload(i), E.error("E7", F.lit(E.E7_BAD_IMAGE)))
    )


def rendered_size(body) -> Column:
    """RN10: size of the document in bytes."""
    return F.octet_length(F.col(body) if isinstance(body, str) else body).cast("bigint")


def render_report(documents: DataFrame, by: str = "template_path") -> DataFrame:
    """RN10: documents and bytes per template."""
    return documents.groupBy(by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(rendered_size("body")).alias("bytes"),
    )


# Upper bounds of A7's buckets, in microseconds.
DURATION_BOUNDS = (50, 100, 250, 500, 1000, 5000, 25000, 100000)


def duration_histogram(documents: DataFrame, micros: str = "render_us", bounds: tuple[int, ...] = DURATION_BOUNDS) -> DataFrame:
    """A7: cumulative ``le`` buckets of render times, a row a bound and one for
    +Inf. One pass, a counter per bound."""
    row = documents.agg(*[F.count_if(F.col(micros) <= le).alias(f"le_{le}") for le in bounds], F.count(micros).alias("le_inf"))
    pairs = [F.struct(F.lit(str(le)).alias("le"), F.col(f"le_{le}").alias("documents")) for le in bounds]
    return row.select(F.inline(F.array(*pairs, F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("documents")))))


def duration_sketch(documents: DataFrame, by: list[str] | None = None, micros: str = "render_us") -> DataFrame:
    """A7: a KLL sketch of render times per ``by``, as bytes that can be kept and
    merged over batches (``duration_quantiles``); rank error about 1.3 % at its size of 200."""
    return documents.groupBy(*(by or [])).agg(F.kll_sketch_agg_bigint(micros).alias("sketch"))


def duration_quantiles(sketches: DataFrame, at: tuple[float, ...] = (0.5, 0.95, 0.99), by: list[str] | None = None) -> DataFrame:
    """Quantiles of merged sketches, in microseconds: ``by``, quantile, micros."""
    merged = sketches.groupBy(*(by or [])).agg(F.kll_merge_agg_bigint("sketch").alias("s"))
    each = [F.struct(F.lit(q).alias("quantile"), F.kll_sketch_get_quantile_bigint("s", F.lit(q)).alias("micros")) for q in at]
    return merged.select(*(by or []), F.inline(F.array(*each)))
