"""Error catalogue and the error struct every check yields.

Errors are data: a column ``error`` of type struct<code, message>, NULL when
the row is fine. Nothing raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Message texts and codes the reference emits, verbatim.
E0_MISSING_RESOURCE = "composition metadata.resource is missing"
E1_NO_ITEM = "El mensaje de Sentry está incompleto o le falta 'data.item_canonico'."
E2_NO_OUTPUTS = "Falta la lista de outputs de 'item_canonico'."
E3_NO_COMPOSITION = "El output '%s' no tiene entradas de 'composicion'."
E4_EMPTY_DATA = "El nodo de datos de la plantilla está vacío."
E5_INVALID_PATH = "Invalid template path: %s. Path must not contain '..' or absolute paths."
E5_BLANK = "null or empty"
E6_NOT_FOUND = "Template not found: %s"
E6_DOWNLOAD_FAILED = "Failed to download template: %s"
E6_BLANK_URI = "URI is null or empty"
E6_NO_DOWNLOADER = "No downloader found for URI: %s. Supported protocols: [s3@, fs@, http]"
E7_BAD_IMAGE = "Invalid Base64 image encoding"
E8_PROCESSING = "Failed to generate document: %s"
E8_HTML = "Failed to generate HTML document: %s"
E9_RESULTS_MISMATCH = "Número de resultados (%d) no coincide con número de templates procesados"
E9_RESULTS_COUNT = "Número de resultados (%d) no coincide con número de templates (%d)"
E11_RECORD = "Record Topic %s, Key %s, Offset %d: %s"
DATA_NOT_OBJECT = "Cannot convert template data: node is not a JSON object"

# Class -> (error code, HTTP status, generic message or None to keep the text)
ERROR_CLASSES = {
    "TemplateNotFound": ("TEMPLATE_NOT_FOUND", 404, None),
    "InvalidTemplatePath": (
        "INVALID_TEMPLATE_PATH",
        400,
        "Invalid template path. Paths must be relative and cannot contain '..' or absolute references.",
    ),
    "InvalidTemplateData": ("INVALID_TEMPLATE_DATA", 400, None),
    "TemplateProcessing": (
        "TEMPLATE_PROCESSING_ERROR",
        500,
        "Failed to process template. Please check template format and data.",
    ),
    "DocumentGeneration": ("DOCUMENT_GENERATION_ERROR", 500, "An error occurred while generating the document."),
}

# Error code used in this package -> exception class of the reference.
# E0 and E4b are plain runtime errors there, outside its own hierarchy.
CODE_CLASS = {
    "E0": "Runtime",
    "E1": "InvalidTemplateData",
    "E2": "InvalidTemplateData",
    "E3": "InvalidTemplateData",
    "E4": "InvalidTemplateData",
    "E4b": "Runtime",
    "E5": "InvalidTemplatePath",
    "E6": "TemplateNotFound",
    "E7": "InvalidTemplateData",
    "E8": "TemplateProcessing",
    "E9": "InvalidTemplateData",
    "E10": "DocumentGeneration",
    "E11": "Envelope",
}

ERROR_DDL = "struct<code:string, message:string>"


def error(code: str, message: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), message.cast("string").alias("message"))


def no_error() -> Column:
    return F.lit(None).cast(ERROR_DDL)


def first_error(*checks: tuple[Column, str, Column]) -> Column:
    """``CASE`` over (condition, code, message) triples, first match wins."""
    expr = None
    for cond, code, msg in checks:
        expr = F.when(cond, error(code, msg)) if expr is None else expr.when(cond, error(code, msg))
    return expr.otherwise(no_error()) if expr is not None else no_error()


def classify_error(code: Column, message: Column) -> Column:
    """V10: error code column + message -> struct<error, message, status>.

    Mirrors the exception-to-response mapping: path, processing and base
    errors get a generic text, data and not-found errors keep their own.
    """
    cls = F.coalesce(
        F.element_at(F.create_map(*[x for k, v in CODE_CLASS.items() for x in (F.lit(k), F.lit(v))]), code),
        F.lit("DocumentGeneration"),
    )
    mapped = None
    for name, (err, status, generic) in ERROR_CLASSES.items():
        body = F.struct(
            F.lit(err).alias("error"),
            (F.lit(generic) if generic else message).alias("message"),
            F.lit(status).alias("status"),
        )
        mapped = F.when(cls == name, body) if mapped is None else mapped.when(cls == name, body)
    fallback = ERROR_CLASSES["DocumentGeneration"]
    return mapped.otherwise(
        F.struct(F.lit(fallback[0]).alias("error"), F.lit(fallback[2]).alias("message"), F.lit(fallback[1]).alias("status"))
    )
