"""RS10 collate results back into the message; V8 result-count check.

The echo is parsed with opaque nodes as VARIANT so that ``to_json`` writes
them back as nested JSON; arrays go through the same single-value wrapping
as the binding parse, so positions agree. Each template composition gets
``metadata.result.location``; ``metadata``/``result`` are created when
missing; other compositions are untouched. Locations are a pure function of
the request key, so collation is evaluated inside the message row: no join
with the document rows and no shuffle.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors as E
from ..functions._util import let
from ..schema import JSON_READ_OPTIONS, JSON_WRITE_OPTIONS
from ..sources.messages import needs_wrap, wrap_single

ECHO_TOP = (
    "metadata variant, data struct<cliente:variant, clienteData:variant, item_canonico:struct<"
    "output_producto:string, output_subproducto:string, output_metadata:variant, outputs:string, "
    "callback:variant, metadata:variant, _error:variant>>"
)
ECHO_OUTPUTS = "array<struct<type:string, composicion:string>>"
ECHO_RESOURCE = (
    "struct<input_format:string, output_format:string, location:string, data:variant, error:variant, _error:variant>"
)
ECHO_COMPOSITIONS = (
    "array<struct<template:string, data:variant, resource:string, type:string, "
    f"metadata:struct<resource:{ECHO_RESOURCE}, result:struct<location:string>>>>"
)
ECHO_DIRECT = ECHO_TOP.replace("outputs:string", f"outputs:array<struct<type:string, composicion:{ECHO_COMPOSITIONS}>>")


def _with_location(c: Column, location: Column) -> Column:
    meta = c["metadata"]
    result = F.struct(location.alias("location"))
    new_meta = F.when(
        meta.isNull(), F.struct(F.lit(None).cast(ECHO_RESOURCE).alias("resource"), result.alias("result"))
    ).otherwise(
        F.struct(meta["resource"].alias("resource"), F.coalesce(meta["result"], F.struct(F.lit(None).cast("string").alias("location"))).withField("location", location).alias("result"))
    )
    return c.withField("metadata", new_meta)


def collated_response(raw: Column, location_of: Callable[[Column, Column, Column], Column]) -> Column:
    """RS10 as a Column: the message JSON with locations filled in.

    ``location_of(output_pos, comp_pos, composition)`` gives the location of
    one template composition (``composition`` is the echo struct).
    """
    def fill(comps: Column, i: Column) -> Column:
        return F.transform(
            comps,
            lambda c, k: F.when(
                F.coalesce(c["type"] == "template", F.lit(False)), _with_location(c, location_of(i, k, c))
            ).otherwise(c),
        )

    def message(echo: Column, outputs: Column) -> Column:
        item = echo["data"]["item_canonico"]
        new_item = F.struct(
            item["output_producto"].alias("output_producto"),
            item["output_subproducto"].alias("output_subproducto"),
            item["output_metadata"].alias("output_metadata"),
            outputs.alias("outputs"),
            item["callback"].alias("callback"),
            item["metadata"].alias("metadata"),
            item["_error"].alias("_error"),
        )
        return F.to_json(F.struct(
            echo["metadata"].alias("metadata"),
            F.struct(
                echo["data"]["cliente"].alias("cliente"),
                echo["data"]["clienteData"].alias("clienteData"),
                new_item.alias("item_canonico"),
            ).alias("data"),
        ), JSON_WRITE_OPTIONS)

    # fast path: one typed parse when no array is written as a lone object
    def direct(echo: Column) -> Column:
        outs = echo["data"]["item_canonico"]["outputs"]
        return message(echo, F.transform(outs, lambda o, i: F.struct(o["type"].alias("type"), fill(o["composicion"], i).alias("composicion"))))

    # layered path (RS9)
    def layered(echo: Column) -> Column:
        outs = F.from_json(let(echo["data"]["item_canonico"]["outputs"], wrap_single), ECHO_OUTPUTS, JSON_READ_OPTIONS)
        return message(echo, F.transform(
            outs,
            lambda o, i: F.struct(
                o["type"].alias("type"),
                fill(F.from_json(wrap_single(o["composicion"]), ECHO_COMPOSITIONS, JSON_READ_OPTIONS), i).alias("composicion"),
            ),
        ))

    # Each echo is parsed once, though the message takes it apart at many places.
    return F.when(
        needs_wrap(raw), let(F.from_json(raw, ECHO_TOP, JSON_READ_OPTIONS), layered)
    ).otherwise(let(F.from_json(raw, ECHO_DIRECT, JSON_READ_OPTIONS), direct))


def check_result_counts(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """V8: messages whose number of documents differs from their number of
    template compositions, with the reference's E9 text."""
    r = requests.groupBy("msg_id").agg(F.count(F.lit(1)).alias("templates"))
    d = documents.groupBy("msg_id").agg(F.count(F.lit(1)).alias("results"))
    j = r.join(d, "msg_id", "full").fillna(0, ["templates", "results"])
    return j.where(F.col("templates") != F.col("results")).select(
        "msg_id",
        F.col("templates").cast("bigint").alias("templates"),
        F.col("results").cast("bigint").alias("results"),
        E.error("E9", F.format_string(E.E9_RESULTS_COUNT, F.col("results"), F.col("templates"))).alias("error"),
    )


