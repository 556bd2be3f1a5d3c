"""RN11: the whole document-generation plan for a batch of messages.

    parse (SO1) -> validate in-row (V1-V4) -> explode requests (RS1-RS4)
    -> resolve templates (J1, measured broadcast) -> render (RN1-RN9)
    -> per-message status (V9) -> collate in-row (RS10)

A template table whose keys the driver may list (ids and parse errors, never
contents) lets every check run inside the message row; a larger one is joined.
Both give the same rows. Shuffles: the template join only when the template
table is too big to broadcast, and beyond the listing limit the group-by of
*failed* requests by message (small) with its join back. Document locations are
derived from ``as_of`` and the request key, so a rerun of the same batch names
the same files.

A message is ok when every document has a body or is explicitly pending (PDF
without a registered converter); only documents with a body get a location.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors as E
from ..functions import document_filename, has_protocol, local_location, sortable_id
from ..functions._util import fenced, let
from ..operators.collate import collated_response
from ..operators.lookup import BROADCAST_LIMIT_BYTES, resolve_templates
from ..operators.render import CACHE_DIR, RENDERERS, pdf_images_error, pending_formats, rendered, route_format, template_error
from ..operators.reshape import extract_images, flatten_outputs, only_templates, project_request
from ..operators.validate import is_template, validate_messages
from ..sources.templates import lookup_keys, missing_cause
from ..schema import REQUEST_KEY
from ..session import configure
from ..sources.messages import parse_messages

TEMP_DIR = "/temp"
# Template keys that the driver lists at most; beyond, resolution is a join.
MAX_TEMPLATE_KEYS = 10_000


@dataclass
class Generation:
    messages: DataFrame  # msg_id, ok, error_code, error_message, response, documents, pending
    documents: DataFrame  # one row per document of a successful message, pending ones too
    requests: DataFrame  # every template request of messages that passed mapping


def _as_of(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def document_id(as_of, msg_id: Column, output_pos: Column, comp_pos: Column) -> Column:
    return sortable_id(_as_of(as_of), F.concat_ws(":", msg_id, output_pos.cast("string"), comp_pos.cast("string")))


def local_path(temp_dir: str, doc_id: Column, file_type: Column) -> Column:
    return F.concat(F.lit(temp_dir + "/"), document_filename(doc_id, file_type))


def _template_id(source: Column, key: Column) -> Column:
    return F.concat(source, F.lit("|"), key)


def template_listing(templates: DataFrame, key_limit: int = MAX_TEMPLATE_KEYS) -> tuple[list[str], dict[str, str]] | None:
    """(all template ids, {id: why its content cannot be parsed}).

    One aggregate job counts the keys; only within the limit does one more job
    bring the ids to the driver, after executors parsed each content. None when
    there are too many keys to list (the caller then resolves with a join).
    """
    if templates.count() > key_limit:
        return None
    rows = templates.select(_template_id(F.col("source"), F.col("key")).alias("tid"), template_error("content").alias("error")).collect()
    return sorted(r["tid"] for r in rows), {r["tid"]: r["error"] for r in rows if r["error"] is not None}


def not_found_error(path: Column, fmt: Column, found: Column, failure: Column) -> Column:
    """V6/V7: E6 with the reference's wording for each way a lookup fails."""
    needs = (fmt != "txt") | has_protocol(path)
    download = F.coalesce(failure, missing_cause(path))
    msg = F.when(has_protocol(path), F.format_string(E.E6_NOT_FOUND, F.format_string(E.E6_DOWNLOAD_FAILED, download))).otherwise(
        F.format_string(E.E6_NOT_FOUND, path)
    )
    return F.when(needs & ~found, E.error("E6", msg))


def malformed_error(fmt: Column, why: Column) -> Column:
    """E8: an HTML request whose template cannot be parsed."""
    return F.when((fmt == "html") & why.isNotNull(), E.error("E8", F.format_string(E.E8_HTML, why)))


def render_check(comp: Column, known: list[str], malformed: dict[str, str]) -> Column:
    """Per-composition render-stage errors evaluated in the message row:
    template resolution (E6), for HTML its parse (E8), for PDF the image
    payloads (E7/E8)."""
    return let(route_format(comp["output_format"]), lambda fmt: _render_check(comp, fmt, known, malformed))


def _render_check(comp: Column, fmt: Column, known: list[str], malformed: dict[str, str]) -> Column:
    path = comp["location"]
    tids, failure = lookup_keys(path, fmt, _template_id)
    there = [F.coalesce(t.isin(known), F.lit(False)) for t in tids]
    found = there[0] | there[1] | there[2]
    errors = [not_found_error(path, fmt, found, failure)]
    if malformed:
        tid = F.when(there[0], tids[0]).when(there[1], tids[1]).when(there[2], tids[2])
        why = F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(sorted(malformed.items())))), tid)
        errors.append(malformed_error(fmt, why))
    return F.coalesce(*errors, F.when(fmt == "pdf", let(extract_images(comp["data"]), pdf_images_error)))


def first_render_error(outputs: Column, known: list[str], malformed: dict[str, str]) -> Column:
    """V9 (render stage): first failing template composition by position."""
    errs = F.flatten(F.transform(outputs, lambda o: F.transform(F.filter(o["composicion"], is_template), lambda c: render_check(c, known, malformed))))
    return F.try_element_at(F.filter(errs, lambda e: e.isNotNull()), F.lit(1))


def generate_documents(
    messages: DataFrame,
    templates: DataFrame,
    as_of,
    temp_dir: str = TEMP_DIR,
    cache_dir: str = CACHE_DIR,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
    key_limit: int | None = None,
    kept: str | None = None,
) -> Generation:
    """Run the pipeline over ``messages(msg_id, raw)`` and ``templates``.

    With a template table small enough to list (the usual case) every check
    runs inside the message row: the status of the messages is one narrow pass.
    Otherwise template resolution is a join and the failures are folded per
    message. Bodies are rendered by the same step either way.

    ``kept`` names a new folder for the status of the messages: it is computed and
    written there once, with the responses and the parsed outputs of successful
    messages, and both frames read it. Without it each frame computes its own.
    """
    configure(messages.sparkSession)
    templates = templates.select("source", "key", "content", "fetched_at")
    listing = template_listing(templates, MAX_TEMPLATE_KEYS if key_limit is None else key_limit)
    validated = validate_messages(parse_messages(messages.select("msg_id", "raw")))
    if listing is None:
        status = _status_by_join(validated, templates, broadcast_limit)
    else:
        known, malformed = listing
        checked = F.coalesce(F.col("map_error"), first_render_error(F.col("outputs"), known, malformed))
        status = validated.withColumn("error", fenced(checked))

    def location_of(i: Column, k: Column, comp: Column) -> Column:
        ft = comp["metadata"]["resource"]["output_format"]
        where = local_location(local_path(temp_dir, document_id(as_of, F.col("msg_id"), i, k), ft))
        return F.when(~route_format(ft).isin(pending_formats()), where) if pending_formats() else where

    def count(test) -> Column:
        each = F.transform("outputs", lambda o: F.size(F.filter(o["composicion"], test)))
        return F.coalesce(F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(0))

    ok = F.col("error").isNull()
    pending = F.lit(0)
    if pending_formats():
        pending = count(lambda c: is_template(c) & route_format(c["output_format"]).isin(pending_formats()))
    columns = [
        F.col("msg_id"),
        ok.alias("ok"),
        F.col("error.code").alias("error_code"),
        F.col("error.message").alias("error_message"),
        F.when(ok, collated_response(F.col("raw"), location_of)).alias("response"),
        # documents of a successful message: all of them, and those that wait for a converter
        F.when(ok, count(is_template)).otherwise(F.lit(0)).cast("bigint").alias("documents"),
        F.when(ok, pending).otherwise(F.lit(0)).cast("bigint").alias("pending"),
    ]

    def answered(*more: Column) -> DataFrame:
        # documents with a body are those that don't wait
        return status.select(*columns, *more).withColumn("documents", F.col("documents") - F.col("pending"))

    out = answered()

    def requests_of(frame: DataFrame) -> DataFrame:
        return project_request(only_templates(flatten_outputs(frame))).withColumn("format", route_format("file_type"))

    requests = requests_of(validated.where(F.col("map_error").isNull()).select("msg_id", "outputs"))
    passed = status.where(F.col("error").isNull()).select("msg_id", "outputs")
    if kept is not None:
        answered(F.when(ok, F.col("outputs")).alias("outputs")).write.parquet(kept)
        rows = messages.sparkSession.read.parquet(kept)
        out, passed = rows.drop("outputs"), rows.where("ok").select("msg_id", "outputs")
    documents = requests_of(passed)
    documents = _render(resolve_templates(documents, templates, limit_bytes=broadcast_limit), as_of, temp_dir, cache_dir)
    return Generation(messages=out, documents=documents, requests=requests)


def _status_by_join(validated: DataFrame, templates: DataFrame, broadcast_limit: int) -> DataFrame:
    """``validated`` with ``error``: resolution is a (measured-broadcast or shuffle)
    join with the template keys, failures are folded per message with a group-by
    of the failed requests only, then joined back."""
    # Contents are parsed where they lie; what is joined is the key and why it failed.
    keys = templates.select("source", "key", F.coalesce(template_error("content"), F.lit("")).alias("content"), "fetched_at")
    req = project_request(only_templates(flatten_outputs(validated.where(F.col("map_error").isNull())))).withColumn("format", route_format("file_type"))
    res = resolve_templates(req, keys, limit_bytes=broadcast_limit)
    fmt = F.col("format")
    error = F.coalesce(
        not_found_error(F.col("template_path"), fmt, F.col("template_found"), F.col("template_failure")),
        malformed_error(fmt, F.nullif(F.col("template_content"), F.lit(""))),
        F.when(fmt == "pdf", pdf_images_error("images")),
    )
    failed = (
        res.withColumn("render_error", error)
        .where(F.col("render_error").isNotNull())
        .groupBy("msg_id")
        .agg(F.min_by("render_error", F.struct("output_pos", "comp_pos")).alias("render_error"))
    )
    return validated.join(failed, "msg_id", "left").withColumn("error", F.coalesce("map_error", "render_error")).drop("render_error")


def _render(req: DataFrame, as_of, temp_dir: str, cache_dir: str) -> DataFrame:
    """Bodies and names of requests that passed every check. A document that
    waits for a converter has no body and no location yet."""
    doc_id = document_id(as_of, F.col("msg_id"), F.col("output_pos"), F.col("comp_pos"))
    lp = local_path(temp_dir, doc_id, F.col("file_type"))
    out = req.withColumn("_r", rendered("format", F.col("template_path"), "template_content", "data", "images", cache_dir)).select(
        *REQUEST_KEY,
        "template_path", "file_type", "format", "data", "images", "template_content",
        doc_id.alias("doc_id"),
        lp.alias("local_path"),
        F.col("_r.body").alias("body"),
        F.col("_r.micros").alias("render_us"),
        F.when(F.col("format").isin("txt", "html"), F.lit("rendered")).otherwise(F.lit("needs_converter")).alias("status"),
    )
    if RENDERERS:  # split once by format: each renderer sees its own rows
        plain = out.where(~F.col("format").isin(list(RENDERERS)))
        for f, fn in RENDERERS.items():
            plain = plain.unionByName(fn(out.where(F.col("format") == f)), allowMissingColumns=True)
        out = plain
    return out.drop("template_content").withColumn("location", F.when(F.col("status") == "rendered", local_location("local_path")))
