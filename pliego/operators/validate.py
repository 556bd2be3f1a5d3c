"""Validation. Every check yields an error struct, never raises.

The mapping checks of one message (V1-V4) are evaluated inside the message
row with array functions, in the reference's order: structure first, then
per output the composition-list check followed by each template composition
(resource present, data present, data is an object, path is safe). The
first failing check is the message's mapping error. No shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors as E
from ..functions._util import fenced
from ..functions.uris import path_error_subject, path_is_unsafe

TEMPLATE = "template"


def is_template(comp: Column) -> Column:
    """RS2 predicate: ``type = 'template'`` (case-sensitive; NULL is not)."""
    return F.coalesce(comp["type"] == F.lit(TEMPLATE), F.lit(False))


def composition_error(comp: Column) -> Column:
    """V3/V4 for one template composition, in the reference's order."""
    data = comp["data"]
    loc = comp["location"]
    return E.first_error(
        (~comp["has_resource"], "E0", F.lit(E.E0_MISSING_RESOURCE)),
        (data.isNull(), "E4", F.lit(E.E4_EMPTY_DATA)),
        (~comp["data_is_object"], "E4b", F.lit(E.DATA_NOT_OBJECT)),
        (path_is_unsafe(loc), "E5", F.format_string(E.E5_INVALID_PATH, path_error_subject(loc))),
    )


def check_structure(parsed_ok: Column, has_item: Column, outputs: Column) -> Column:
    """V1: E1 when there is no item_canonico, E2 when outputs is null/empty."""
    return E.first_error(
        (~parsed_ok | ~has_item, "E1", F.lit(E.E1_NO_ITEM)),
        (F.coalesce(F.size(outputs), F.lit(0)) <= 0, "E2", F.lit(E.E2_NO_OUTPUTS)),
    )


def check_composition(output: Column) -> Column:
    """V2: an output with a null/empty composition list (E3)."""
    return F.when(
        F.coalesce(F.size(output["composicion"]), F.lit(0)) <= 0,
        E.error("E3", F.format_string(E.E3_NO_COMPOSITION, F.coalesce(output["type"], F.lit("null")))),
    )


def mapping_error(outputs: Column) -> Column:
    """V2-V4 in stream order; first error of the message or NULL."""
    empty = F.array().cast(f"array<{E.ERROR_DDL}>")
    per_output = F.transform(
        outputs,
        lambda o: F.concat(
            F.array(check_composition(o)),
            F.coalesce(F.transform(F.filter(o["composicion"], is_template), composition_error), empty),
        ),
    )
    found = F.filter(F.flatten(per_output), lambda e: e.isNotNull())
    return F.try_element_at(found, F.lit(1))


def validate_messages(parsed: DataFrame) -> DataFrame:
    """Adds ``map_error`` (struct<code,message> or NULL) to parsed messages."""
    structural = check_structure(F.col("parsed_ok"), F.col("has_item"), F.col("outputs"))
    return parsed.withColumn("map_error", fenced(F.coalesce(structural, mapping_error(F.col("outputs")))))
