"""JSON nodes of a data object, as the binding and rendering steps see them.

A data node is carried as JSON text, so that key order and repeated keys
survive. The steps that walk it parse that text into nodes of their own kind
(object, list, text, number, boolean, null), at any depth, inside Arrow-batched
UDFs; what only needs the top level stays a Spark expression.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: nesting the reference's JSON reader accepts.
MAX_NESTING = 2000


def entries(text: Column) -> Column:
    """array<struct<key, value>> of a JSON object in document order
    (repeated keys all kept); NULL if the text is not an object."""
    return F.map_entries(F.from_json(text, "map<string,string>"))


def as_map(text: Column) -> Column:
    """map<string,string> of a JSON object, last value wins."""
    return F.map_from_entries(entries(text))


def keys(text: Column) -> Column:
    """The keys of ``as_map``, without reading the values: NULL if the text is not an object."""
    return F.array_distinct(F.json_object_keys(text))


# ------------------------------------------------- nodes, inside tasks ----


class Number(str):
    """A JSON number, kept as the text Java prints for it."""

    __slots__ = ()


def _double(text: str) -> Number:
    """``Double.toString`` of a JSON number with a fraction or an exponent."""
    v = float(text)
    if v != v or v in (float("inf"), float("-inf")):
        return Number("Infinity" if v > 0 else "-Infinity")
    if v == 0:
        return Number("-0.0" if text.startswith("-") else "0.0")
    digits, exp = f"{abs(v):.17e}".split("e")
    digits, exp = repr(abs(v)), int(exp)
    mantissa = digits.split("e")[0].replace(".", "").lstrip("0").rstrip("0") or "0"
    sign = "-" if v < 0 else ""
    if 1e-3 <= abs(v) < 1e7:
        if exp >= 0:
            whole, frac = mantissa[: exp + 1].ljust(exp + 1, "0"), mantissa[exp + 1 :]
        else:
            whole, frac = "0", "0" * (-exp - 1) + mantissa
        return Number(f"{sign}{whole}.{frac or '0'}")
    return Number(f"{sign}{mantissa[0]}.{mantissa[1:] or '0'}E{exp}")


# One decoder for all texts: json.loads with hooks makes a new one, and its scanner, each time.
_DECODER = json.JSONDecoder(parse_int=Number, parse_float=_double, parse_constant=Number, strict=False)


def load(text: str | None):
    """The node of a JSON text: dict (each key at its first place with its last
    value, as a linked map), list, str, Number, bool or None."""
    if text is None:
        return None
    if sys.getrecursionlimit() < 4 * MAX_NESTING:
        sys.setrecursionlimit(4 * MAX_NESTING)
    if text.startswith("\ufeff"):  # as json.loads has it
        raise json.JSONDecodeError("Unexpected UTF-8 BOM (decode using utf-8-sig)", text, 0)
    return _DECODER.decode(text)


def java_text(node) -> str:
    """``String.valueOf`` of a node converted to Java collections:
    ``{k=v, ...}`` for objects, ``[a, b]`` for lists, ``null`` for null."""
    if isinstance(node, dict):
        return "{" + ", ".join(f"{k}={java_text(v)}" for k, v in node.items()) + "}"
    if isinstance(node, list):
        return "[" + ", ".join(map(java_text, node)) + "]"
    if node is None:
        return "null"
    return str(node).lower() if isinstance(node, bool) else str(node)


def flatten(node, null_text: str = "") -> dict:
    """RS6-RS8: every leaf under its own name, the last one of a name winning;
    a list is a list of maps, each item flattened under the list's name."""
    out: dict = {}
    if isinstance(node, dict):
        for k, v in node.items():
            _put(k, v, out, null_text)
    return out


def _put(name: str, node, out: dict, null_text: str) -> None:
    if isinstance(node, dict):
        for k, v in node.items():
            _put(k, v, out, null_text)
    elif isinstance(node, list):
        items = []
        for item in node:
            one: dict = {}
            _put(name, item, one, null_text)
            items.append(one)
        out[name] = items
    else:
        out[name] = null_text if node is None else java_text(node)
