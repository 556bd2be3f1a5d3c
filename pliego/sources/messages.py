"""SO1 read/parse messages, RS9 single-value-as-array.

Parsing is layered so that a lone object where an array is expected is
accepted at every level (Jackson's ACCEPT_SINGLE_VALUE_AS_ARRAY): each array
is first read as raw JSON text, wrapped in ``[...]`` when it is an object,
then parsed. Everything is a per-row expression: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions._util import fenced, let
from ..operators.lookup import measured_broadcast
from ..schema import JSON_READ_OPTIONS
from ..session import configure

CORRUPT = "_corrupt"
RUN = 4096  # equal lines of a file that a row stands for while they are numbered

TOP_DDL = (
    "metadata string, "
    "data struct<cliente:string, clienteData:string, item_canonico:struct<"
    "output_producto:string, output_subproducto:string, outputs:string>>, "
    f"{CORRUPT} string"
)
OUTPUT_DDL = "array<struct<type:string, composicion:string>>"
# Binding view of a composition: only what mapping and rendering read.
COMPOSITION_DDL = (
    "array<struct<type:string, metadata:struct<resource:struct<"
    "output_format:string, location:string, data:string>>>>"
)


def wrap_single(text) -> Column:
    """RS9: a JSON object where an array is expected becomes a 1-element array."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(F.ltrim(t).startswith("{"), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t)


def read_messages(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """SO1 source: one message per line (or per file with ``whole_file``).

    Returns ``msg_id, raw``. ``msg_id`` is the file and a hash of the text, so it
    depends neither on split sizes nor on retries; lines that a file repeats
    get their number among their equals as well.
    """
    df = spark.read.text(path, wholetext=whole_file).select(F.input_file_name().alias("_f"), F.col("value").alias("raw"))
    df = df.where(F.length(F.trim("raw")) > 0).withColumn("_h", F.md5("raw"))
    # Only lines that come again are shuffled; their keys are broadcast when measured small.
    again = measured_broadcast(df.groupBy("_f", "_h").count().where("count > 1").select("_f", "_h"))
    once = df.join(again, ["_f", "_h"], "left_anti").select(F.concat_ws(":", "_f", "_h").alias("msg_id"), "raw")
    # Equal lines are alike, so they are counted (combined where they are read) and dealt
    # out again in runs of RUN: no task holds or numbers all lines of a hot text.
    texts = df.join(again, ["_f", "_h"], "left_semi").groupBy("_f", "_h", "raw").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_f", "_h").orderBy("raw").rowsBetween(Window.unboundedPreceding, -1))
    texts = texts.withColumn("_b", F.coalesce(before, F.lit(0)))  # other texts of the same hash
    runs = texts.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(RUN).cast("long"))))
    # A number given to repartition() keeps the small rows of the runs apart.
    runs = runs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_f", "_h", "_b", "_s")
    more = runs.withColumn("_i", F.explode(F.sequence(F.col("_s") + 1, F.least(F.col("_s") + RUN, "_n"))))
    number = (F.col("_b") + F.col("_i")).cast("string")
    return once.unionByName(more.select(F.concat_ws(":", "_f", "_h", number).alias("msg_id"), "raw"))


# One-shot binding schema: used when no array is written as a lone object.
DIRECT_DDL = (
    "metadata string, "
    "data struct<cliente:string, clienteData:string, item_canonico:struct<"
    "output_producto:string, output_subproducto:string, outputs:array<struct<type:string, composicion:"
    + COMPOSITION_DDL + ">>>>, "
    f"{CORRUPT} string"
)
# The same positions, but ``data`` read as a map: NULL unless it is an object.
KIND_DDL = "array<struct<metadata:struct<resource:struct<data:map<string,string>>>>>"
# A lone object where the message has an array, data that is a JSON string (its
# text could start like an object), or an escaped character that could hide
# either key: the cases that need the layered parse. A false positive (the text
# inside a string value) only costs the slower path, never a different result.
# The patterns search the whole text, which costs as much as parsing it, so they
# run on those messages alone whose direct parse leaves the question open.
# One pattern per key: a pattern that begins with a whole key is searched many times
# faster than alternatives, which are tried at every character.
LONE_OBJECT = [r'"outputs"\s*:\s*\{', r'"composicion"\s*:\s*\{']
TEXT_DATA = r'"data"\s*:\s*"'
ESCAPED = r"\u00"


def needs_wrap(raw: Column) -> Column:
    return F.coalesce(raw.rlike(LONE_OBJECT[0]) | raw.rlike(LONE_OBJECT[1]), F.lit(False))


def needs_layers(raw: Column) -> Column:
    return needs_wrap(raw) | F.coalesce(raw.rlike(TEXT_DATA) | raw.contains(ESCAPED), F.lit(False))


def unsure(raw: Column, direct: Column) -> Column:
    """Whether the layered parse could give something else than ``direct``: a lone object
    is a type that ``direct`` reports as corrupt, and a JSON string that passes for an
    object starts with ``{"``, so its quote is escaped, or else unlike a written object."""
    def odd(c: Column) -> Column:
        data = c["metadata"]["resource"]["data"]
        return F.coalesce(~data.startswith('{"') & F.ltrim(data).startswith("{"), F.lit(False))

    outs = direct["data"]["item_canonico"]["outputs"]
    some = F.exists(outs, lambda o: F.coalesce(F.exists(o["composicion"], odd), F.lit(False)))
    return direct[CORRUPT].isNotNull() | F.coalesce(raw.contains("\\") | some, F.lit(False))


def parse_messages(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """SO1: typed binding view of each message, next to the raw text.

    Adds ``parsed_ok`` (the text is a JSON object), ``has_item``,
    ``outputs`` = array<struct<type, composicion: array<struct<type,
    output_format, location, data, has_resource, data_is_object>>>> (NULL when
    absent).
    """
    configure(messages.sparkSession)
    opts = dict(JSON_READ_OPTIONS, columnNameOfCorruptRecord=CORRUPT)

    def comp_view(c: Column, is_object: Column) -> Column:
        res = c["metadata"]["resource"]
        return F.struct(
            c["type"].alias("type"),
            res["output_format"].alias("output_format"),
            res["location"].alias("location"),
            res["data"].alias("data"),
            (c["metadata"].isNotNull() & res.isNotNull()).alias("has_resource"),
            F.coalesce(is_object, F.lit(False)).alias("data_is_object"),
        )

    def view(outs: Column, comps: callable) -> Column:
        return F.transform(outs, lambda o: F.struct(o["type"].alias("type"), comps(o).alias("composicion")))

    def direct_comps(o: Column) -> Column:
        # no data node is a string here, so its text tells an object
        return F.transform(o["composicion"], lambda c: comp_view(c, F.ltrim(c["metadata"]["resource"]["data"]).startswith("{")))

    def layered_comps(o: Column) -> Column:
        text = wrap_single(o["composicion"])
        kinds = F.from_json(text, KIND_DDL, JSON_READ_OPTIONS)
        return F.zip_with(
            F.from_json(text, COMPOSITION_DDL, JSON_READ_OPTIONS), kinds,
            lambda c, k: comp_view(c, k["metadata"]["resource"]["data"].isNotNull()),
        )

    # fast path: one typed parse; layered path, where that one won't do: arrays read as
    # text, wrapped when a lone object, parsed. Each is read once, before its fields are.
    def paths(direct: Column) -> Column:
        layered = F.when(unsure(F.col(raw), direct) & needs_layers(F.col(raw)), F.from_json(F.col(raw), TOP_DDL, opts))
        return F.struct(direct.alias("direct"), layered.alias("top"))

    df = messages.withColumn("_parsed", fenced(let(F.from_json(F.col(raw), DIRECT_DDL, opts), paths)))
    direct, top = F.col("_parsed.direct"), F.col("_parsed.top")
    outs = F.from_json(wrap_single(top["data"]["item_canonico"]["outputs"]), OUTPUT_DDL, JSON_READ_OPTIONS)

    def pick(layered: Column, direct: Column) -> Column:
        return F.when(top.isNotNull(), layered).otherwise(direct)

    return df.select(
        *[c for c in messages.columns],
        (pick(top[CORRUPT], direct[CORRUPT]).isNull() & F.col(raw).isNotNull()).alias("parsed_ok"),
        pick(top["data"]["item_canonico"].isNotNull(), direct["data"]["item_canonico"].isNotNull()).alias("has_item"),
        fenced(pick(view(outs, layered_comps), view(direct["data"]["item_canonico"]["outputs"], direct_comps))).alias("outputs"),
    )
