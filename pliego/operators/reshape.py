"""Projection, flattening and re-nesting of requests.

RS1 turns validated messages into one row per composition with the key
``(msg_id, output_pos, comp_pos)`` (positions in the message's own lists, so
results can be put back by key rather than by a fragile counter). Two
``posexplode`` generators: narrow, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_local, sanitize_template_path
from ..functions._util import let
from ..schema import REQUEST_KEY
from .jsontext import keys
from .validate import is_template


def flatten_outputs(validated: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """RS1: outputs[] x composicion[] -> rows, order kept in the positions."""
    keep = keep or ["msg_id"]
    o = validated.select(*keep, F.posexplode("outputs").alias("output_pos", "output"))
    c = o.select(
        *keep, "output_pos", F.col("output.type").alias("output_type"),
        F.posexplode("output.composicion").alias("comp_pos", "comp"),
    )
    return c.select(
        *keep, "output_pos", "comp_pos", "output_type",
        F.col("comp.type").alias("comp_type"),
        F.col("comp.output_format").alias("output_format"),
        F.col("comp.location").alias("location"),
        F.col("comp.data").alias("data"),
        F.col("comp.has_resource").alias("has_resource"),
        F.col("comp.data_is_object").alias("data_is_object"),
    )


def only_templates(rows: DataFrame) -> DataFrame:
    """RS2: keep compositions of type 'template' (case-sensitive)."""
    return rows.where(is_template(F.struct(F.col("comp_type").alias("type"))))


def extract_images(data) -> Column:
    """RS4: ``data.images`` as map<string,string> when it is an object of
    scalars; anything else gives an empty map. ``images`` stays in data. Of
    repeated ``images`` keys the last one counts."""
    d = F.col(data) if isinstance(data, str) else data
    # Typed read: a JSON string is not a map, however it starts.
    m = F.map_from_entries(F.map_entries(F.from_json(d, "images map<string,string>")["images"]))
    empty = F.create_map().cast("map<string,string>")

    def scalars(m: Column) -> Column:
        only = F.forall(F.map_values(m), lambda v: v.isNull() | ~(F.ltrim(v).startswith("{") | F.ltrim(v).startswith("[")))
        return F.when(F.coalesce(only, F.lit(False)), m).otherwise(empty)

    return let(m, scalars)


def project_request(rows: DataFrame) -> DataFrame:
    """RS3: request columns: ``template_path`` (the location), ``data`` (JSON
    text), ``file_type`` (raw output format), ``images``, ``persist``=false."""
    return rows.select(
        *REQUEST_KEY,
        F.col("location").alias("template_path"),
        "data",
        F.col("output_format").alias("file_type"),
        extract_images("data").alias("images"),
        F.lit(False).alias("persist"),
    )


def request_profile(requests: DataFrame) -> DataFrame:
    """RS5: what is logged per request: template name, type, #fields,
    images present, persist."""
    return requests.select(
        *REQUEST_KEY,
        sanitize_template_path("template_path").alias("template_name"),
        F.col("file_type"),
        F.coalesce(F.size(keys(F.col("data"))), F.lit(0)).cast("bigint").alias("data_fields"),
        (F.size("images") > 0).alias("has_images"),
        F.col("persist"),
    )


def pick_location(repository_path, local_path) -> Column:
    """RS11: repository path if present, else the local path."""
    rp = F.col(repository_path) if isinstance(repository_path, str) else repository_path
    lp = F.col(local_path) if isinstance(local_path, str) else local_path
    return F.coalesce(rp, lp)


def locations_of(responses: DataFrame, json_col: str = "response", keep: list[str] | None = None) -> DataFrame:
    """RS12: outputs -> compositions -> template -> result.location of a
    (collated) message JSON."""
    keep = keep or ["msg_id"]
    ddl = (
        "data struct<item_canonico:struct<outputs:array<struct<type:string, composicion:array<struct<"
        "type:string, metadata:struct<resource:struct<location:string>, result:struct<location:string>>>>>>>>"
    )
    p = responses.select(*keep, F.from_json(json_col, ddl).alias("m"))
    o = p.select(*keep, F.posexplode("m.data.item_canonico.outputs").alias("output_pos", "o"))
    c = o.select(*keep, "output_pos", F.posexplode("o.composicion").alias("comp_pos", "c"))
    return c.where(F.col("c.type") == "template").select(
        *keep, "output_pos", "comp_pos",
        F.col("c.metadata.resource.location").alias("template_path"),
        F.col("c.metadata.result.location").alias("result_location"),
    )


def request_from_flat(df: DataFrame, json_col: str = "raw") -> DataFrame:
    """RS13: a flat ``{templatePath, data, images}`` body -> request columns."""
    p = df.select("*", F.from_json(json_col, "templatePath string, data string, images map<string,string>").alias("_f"))
    return p.select(
        *df.columns,
        F.col("_f.templatePath").alias("template_path"),
        F.col("_f.data").alias("data"),
        F.coalesce(F.col("_f.images"), F.create_map().cast("map<string,string>")).alias("images"),
        is_local(F.col("_f.templatePath")).alias("is_local"),
    )
