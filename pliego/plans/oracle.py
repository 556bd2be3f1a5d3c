"""DuckDB oracle SQL for the registered queries.

Each statement recomputes a query's expected result from the relational
tables (never from the JSON the Spark side builds), with DuckDB's own
functions, so it checks parsing, flattening, validation, binding and
rendering end to end. The fixture rules of ``plans/fixtures.py`` are
restated here as SQL.
"""

from __future__ import annotations

import base64
import re

from .. import errors as E
from . import fixtures as FX
from .queries import AS_OF, DOCS_BUCKET, DOCS_PREFIX, LANDED_ROOTS, PACKAGED_ROOT


# Fixed values, restated here so that a wrong entry in the package shows.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("`", "&#96;"), ("=", "&#61;")]
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CONTENT_TYPES_BY_EXTENSION = {
    "pdf": "application/pdf",
    "html": "text/html",
    "htm": "text/html",
    "txt": "text/plain",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "odt": "application/vnd.oasis.opendocument.text",
    "doc": "application/msword",
}
OCTET_STREAM = "application/octet-stream"


def lit(s) -> str:
    if s is None:
        return "NULL"
    return "'" + str(s).replace("'", "''") + "'"


def case_pick(values: list, index: str) -> str:
    return "CASE " + " ".join(f"WHEN {index} = {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


# ------------------------------------------------------------ scalars ----

def last_index(u: str, ch: str) -> str:
    return f"(CASE WHEN strpos({u}, {lit(ch)}) = 0 THEN -1 ELSE length({u}) - strpos(reverse({u}), {lit(ch)}) END)"


def is_empty(u: str) -> str:
    return f"({u} IS NULL OR {u} = '')"


def is_blank(u: str) -> str:
    return f"({u} IS NULL OR trim({u}) = '')"


def has_protocol(u: str) -> str:
    return f"coalesce(contains({u}, '@'), false)"


def protocol(u: str) -> str:
    return (
        f"(CASE WHEN starts_with({u}, 's3@') THEN 's3@' WHEN starts_with({u}, 'fs@') THEN 'fs@' "
        f"WHEN starts_with({u}, 'http@') OR starts_with({u}, 'https@') THEN 'http' END)"
    )


def file_name_of(p: str) -> str:
    clean = (
        f"(CASE WHEN starts_with({p}, 's3://****') THEN substr({p}, 11) "
        f"WHEN starts_with({p}, 'http://****') THEN substr({p}, 13) "
        f"WHEN starts_with({p}, 'https://****') THEN substr({p}, 14) ELSE {p} END)"
    )
    s = last_index(clean, "/")
    return (
        f"(CASE WHEN {is_empty(p)} THEN '[empty]' WHEN {s} >= 0 AND {s} < length({clean}) - 1 "
        f"THEN substr({clean}, {s} + 2) ELSE {clean} END)"
    )


def sanitize_path(p: str) -> str:
    return f"(CASE WHEN {is_empty(p)} THEN '[empty]' ELSE regexp_extract(regexp_replace({p}, '/+$', ''), '([^/]*)$', 1) END)"


def uri_parses(u: str) -> str:
    scheme_prefix = f"regexp_matches({u}, '^[^/?#]*:')"
    scheme_ok = f"regexp_matches({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*:')"
    illegal = f"regexp_matches({u}, '[ \\\\\"<>^`{{|}}]')"
    return f"(NOT {illegal} AND (NOT {scheme_prefix} OR {scheme_ok}))"


def uri_scheme(u: str) -> str:
    return f"(CASE WHEN regexp_matches({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) END)"


def uri_path(u: str) -> str:
    return (
        f"(CASE WHEN regexp_matches({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://') "
        f"THEN regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) "
        f"WHEN regexp_matches({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL "
        f"ELSE regexp_extract({u}, '^([^?#]*)', 1) END)"
    )


def uri_layers(src: str, col: str = "uri") -> str:
    """CTEs computing the sanitisers of ``col`` in layers (each layer refers
    to the previous one's columns, so the SQL stays linear in size)."""
    u = col
    return f"""l1 AS (SELECT *, {uri_parses(u)} AS u_parses, {uri_scheme(u)} AS u_scheme, {uri_path(u)} AS u_path,
    CASE WHEN strpos({u}, ':') > 0 THEN substr({u}, strpos({u}, ':') + 1) END AS u_after FROM {src}),
l2 AS (SELECT *, {file_name_of(u)} AS fno_uri, {file_name_of('u_path')} AS fno_path, {file_name_of('u_after')} AS fno_after FROM l1),
l3 AS (SELECT *,
    CASE WHEN {is_empty(u)} THEN '[empty]' WHEN starts_with({u}, 's3://') AND u_parses THEN 's3://****/' || fno_path
         WHEN starts_with({u}, 's3://') THEN fno_uri WHEN contains({u}, '@') AND contains({u}, ':') THEN fno_after
         ELSE fno_uri END AS s3_name,
    CASE WHEN {is_empty(u)} THEN '[empty]' WHEN u_parses THEN coalesce(u_scheme, 'http') || '://****/' || fno_path
         ELSE fno_uri END AS http_name FROM l2),
l4 AS (SELECT *, {file_name_of('s3_name')} AS fno_s3, {file_name_of('http_name')} AS fno_http FROM l3),
l5 AS (SELECT *,
    CASE WHEN {is_empty(u)} THEN '[empty]' WHEN starts_with({u}, 's3://') OR starts_with({u}, 's3@') THEN fno_s3
         WHEN starts_with({u}, 'http://') OR starts_with({u}, 'https://') THEN fno_http
         ELSE {sanitize_path(u)} END AS template_name FROM l4)"""


def file_ext(u: str) -> str:
    i = last_index(u, ".")
    return f"(CASE WHEN {i} > 0 AND {i} < length({u}) - 1 THEN substr({u}, {i} + 2) ELSE '' END)"


def content_type(u: str) -> str:
    e = f"lower({file_ext(u)})"
    return "(CASE " + " ".join(f"WHEN {e} = {lit(k)} THEN {lit(v)}" for k, v in CONTENT_TYPES_BY_EXTENSION.items()) + f" ELSE {lit(OCTET_STREAM)} END)"


def path_unsafe(u: str) -> str:
    return (
        f"({is_blank(u)} OR coalesce(contains({u}, '..') OR (NOT contains({u}, '@') AND (starts_with({u}, '/') "
        f"OR starts_with({u}, '\\') OR regexp_matches({u}, '^[a-zA-Z]:'))), false))"
    )


def e5_message(u: str) -> str:
    subject = f"(CASE WHEN {is_blank(u)} THEN 'null or empty' ELSE {u} END)"
    return f"printf({lit(E.E5_INVALID_PATH)}, {subject})"


def resolve_format(f: str) -> str:
    t = f"lower(trim({f}))"
    return f"(CASE WHEN {t} IN ('pdf', 'html', 'txt') THEN {t} ELSE 'pdf' END)"


def b32(n: str, width: int) -> str:
    return f"translate(lpad(to_base({n}, 32), {width}, '0'), {lit(BASE32_DIGITS)}, {lit(CROCKFORD)})"


def sortable_id(ts: str, key: str) -> str:
    h = f"md5({key})"
    hi = f"CAST(('0x' || substr({h}, 1, 10)) AS BIGINT)"
    lo = f"CAST(('0x' || substr({h}, 11, 10)) AS BIGINT)"
    return f"({b32(f'(epoch_us({ts}) // 1000)', 10)} || {b32(hi, 8)} || {b32(lo, 8)})"


def ts_text(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


# ------------------------------------------------------------ fixtures ----

URIS = f"""uris AS (
  SELECT page_id, CAST(v AS BIGINT) AS variant, uri FROM (
    SELECT page_id,
      unnest(range(10)) AS v,
      unnest([url, 'http@' || url, 's3@' || host || ':' || path, 'fs@/srv/' || path, path, '../' || path,
              '/' || path, 's3://' || host || '/' || path, 'C:\\plantillas\\' || path, 'ftp@' || host || '/' || path]) AS uri
    FROM (SELECT page_id, url,
            regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
            regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1) AS path
          FROM pages)))"""

_loc_k = "((l.l_suppkey * 7 + l.l_linenumber) % 40)"
LOCATION = f"(CASE WHEN {_loc_k} < 4 THEN {case_pick(FX.BAD_LOCATIONS, _loc_k)} ELSE {case_pick(FX.GOOD_LOCATIONS, f'({_loc_k} % 6)')} END)"
FORMAT = case_pick(FX.FORMAT_CYCLE, f"(l.l_partkey % {len(FX.FORMAT_CYCLE)})")
IMAGE = case_pick(FX.IMAGE_CYCLE, f"(l.l_partkey % {len(FX.IMAGE_CYCLE)})")


def _mime(b64: str) -> str:
    """Independent MIME sniff of a base64 head (Python, for the fixture's
    fixed image values)."""
    head = b64[:20]
    try:
        if any(c.isspace() for c in head):
            raise ValueError
        data = base64.b64decode(head + "=" * (-len(head) % 4), validate=True)
        if len(head) % 4 == 1:
            raise ValueError
    except Exception:
        return "image/png"
    if len(data) >= 2:
        if data[:2] == b"\x89\x50":
            return "image/png"
        if data[:2] == b"\xff\xd8":
            return "image/jpeg"
        if data[:2] == b"\x47\x49":
            return "image/gif"
        if len(data) >= 4 and data[:2] == b"\x52\x49":
            return "image/webp"
    return "image/png"


DATA_URI = case_pick(
    [None if v is None else f"data:{_mime(v)};base64,{v}" for v in FX.IMAGE_CYCLE], f"(l.l_partkey % {len(FX.IMAGE_CYCLE)})"
)

LINES = f"""lines AS (
  SELECT 'm' || l.l_orderkey || '-' || ((l.l_linenumber - 1) // {FX.LINES_PER_MESSAGE}) AS msg_id,
    o.o_orderstatus AS status, o.o_orderpriority AS priority,
    l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_tax,
    l.l_linestatus, l.l_shipdate, c.c_name, c.c_mktsegment, n.n_name,
    CASE l.l_linestatus WHEN 'F' THEN 'factura' ELSE 'orden' END AS output_type,
    CASE WHEN l.l_linenumber % 5 = 0 THEN 'static' ELSE 'template' END AS comp_type,
    {FORMAT} AS output_format, {LOCATION} AS location, {IMAGE} AS image, {DATA_URI} AS data_uri,
    CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS monto,
    strftime(l.l_shipdate, '%Y-%m-%d') AS fecha,
    'L' || l.l_orderkey || '-' || l.l_linenumber AS codigo,
    CAST(CAST(l.l_quantity AS INTEGER) AS VARCHAR) AS cantidad,
    CAST(CAST(round(l.l_tax * 100) AS INTEGER) AS VARCHAR) || '%' AS impuesto,
    concat_ws(' / ', c.c_name, n.n_name) AS cliente_nombre
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
pos AS (
  SELECT *,
    CAST(dense_rank() OVER (PARTITION BY msg_id ORDER BY l_linestatus) - 1 AS BIGINT) AS output_pos,
    CAST(row_number() OVER (PARTITION BY msg_id, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey,
      l_quantity, l_extendedprice, l_tax, l_shipdate) - 1 AS BIGINT) AS comp_pos,
    CASE WHEN status = 'P' AND priority = '1-URGENT' THEN 'E1' WHEN status = 'P' AND priority = '3-MEDIUM' THEN 'E2'
         WHEN status = 'P' AND priority = '2-HIGH' THEN 'E3' ELSE 'OK' END AS kind
  FROM lines)"""

NO_DOWNLOADER = "ftp@repo.example.com/plantillas/x.html"
E6_FTP = E.E6_NOT_FOUND % (E.E6_DOWNLOAD_FAILED % (E.E6_NO_DOWNLOADER % NO_DOWNLOADER))

COMP = f"""{LINES},
comp AS (
  SELECT *, {resolve_format('output_format')} AS format,
    CASE WHEN comp_type <> 'template' THEN NULL WHEN l_quantity = 50 THEN 'E4' WHEN {path_unsafe('location')} THEN 'E5' END AS map_code,
    CASE WHEN comp_type <> 'template' THEN NULL WHEN l_quantity = 50 THEN {lit(E.E4_EMPTY_DATA)}
         WHEN {path_unsafe('location')} THEN {e5_message('location')} END AS map_msg
  FROM pos WHERE kind IN ('OK', 'E3')),
comp2 AS (
  SELECT *,
    CASE WHEN comp_type <> 'template' THEN NULL WHEN location = {lit(NO_DOWNLOADER)} THEN 'E6'
         WHEN location = 'templates/desconocido.html' AND format <> 'txt' THEN 'E6'
         WHEN location = 'templates/orden.html' AND format = 'pdf' THEN 'E6'
         WHEN format = 'pdf' AND image = '!!notbase64' THEN 'E7' END AS render_code,
    CASE WHEN comp_type <> 'template' THEN NULL WHEN location = {lit(NO_DOWNLOADER)} THEN {lit(E6_FTP)}
         WHEN location = 'templates/desconocido.html' AND format <> 'txt' THEN 'Template not found: templates/desconocido.html'
         WHEN location = 'templates/orden.html' AND format = 'pdf' THEN 'Template not found: templates/orden.html'
         WHEN format = 'pdf' AND image = '!!notbase64' THEN {lit(E.E7_BAD_IMAGE)} END AS render_msg
  FROM comp),
msgs AS (
  SELECT DISTINCT msg_id, kind FROM pos),
first_map AS (
  SELECT msg_id, arg_min(map_code, output_pos * 1000000 + comp_pos) AS code, arg_min(map_msg, output_pos * 1000000 + comp_pos) AS msg
  FROM comp2 WHERE map_code IS NOT NULL GROUP BY msg_id),
first_render AS (
  SELECT msg_id, arg_min(render_code, output_pos * 1000000 + comp_pos) AS code, arg_min(render_msg, output_pos * 1000000 + comp_pos) AS msg
  FROM comp2 WHERE render_code IS NOT NULL GROUP BY msg_id),
status AS (
  SELECT m.msg_id,
    CASE m.kind WHEN 'E1' THEN 'E1' WHEN 'E2' THEN 'E2' ELSE coalesce(fm.code, CASE WHEN m.kind = 'E3' THEN 'E3' END, fr.code) END AS error_code,
    CASE m.kind WHEN 'E1' THEN {lit(E.E1_NO_ITEM)} WHEN 'E2' THEN {lit(E.E2_NO_OUTPUTS)}
      ELSE coalesce(fm.msg, CASE WHEN m.kind = 'E3' THEN {lit(E.E3_NO_COMPOSITION % 'anexo')} END, fr.msg) END AS error_message
  FROM msgs m LEFT JOIN first_map fm ON m.msg_id = fm.msg_id LEFT JOIN first_render fr ON m.msg_id = fr.msg_id),
docs AS (
  SELECT c.*, {sortable_id(f"TIMESTAMP '{AS_OF}'", "c.msg_id || ':' || c.output_pos || ':' || c.comp_pos")} AS doc_id
  FROM comp2 c JOIN status s ON c.msg_id = s.msg_id
  WHERE s.error_code IS NULL AND c.comp_type = 'template')"""

# ------------------------------------------------------------ bodies ----

NL = "chr(10)"


def text_body() -> str:
    path = f"(CASE WHEN contains(location, '@') THEN '/tmp/templates-cache/' || md5(location) || regexp_extract(location, '(\\.[^./]*)$', 1) ELSE location END)"
    fields = [
        ("nombre", "c_name"), ("empresa", "c_mktsegment"), ("monto", "monto"), ("fecha", "fecha"),
        ("codigo", "codigo"), ("cantidad", "cantidad"),
        ("items", "'[{item=base, precio=' || monto || '}, {item=impuesto, precio=' || impuesto || '}]'"),
        ("cliente", "'{nombre=' || cliente_nombre || ', nacion=' || n_name || '}'"),
        ("images", "CASE WHEN image IS NULL THEN 'null' ELSE '{logo=' || image || '}' END"),
    ]
    lines = " || ".join(f"printf('%-20s : %s', {lit(k)}, {v}) || {NL}" for k, v in fields)
    rule_eq, rule_dash = "repeat('=', 60)", "repeat('-', 60)"
    return (
        f"{rule_eq} || {NL} || 'PLAIN TEXT DOCUMENT GENERATOR' || {NL} || {rule_eq} || {NL} || {NL} || "
        f"'Template: ' || {path} || {NL} || {NL} || 'Data:' || {NL} || {rule_dash} || {NL} || {lines} || {rule_dash} || {NL}"
    )


# Schema-aware renderer for the oracle: names resolve statically against the
# fixture's columns (top level) and item struct fields (inside ``items``),
# following Mustache's item-then-parent lookup.
ROOT_SCOPE = {
    "nombre": "c_name", "empresa": "c_mktsegment", "monto": "monto", "fecha": "fecha", "codigo": "codigo",
    "cantidad": "cantidad", "imagen_logo": "data_uri",
    "cliente": "'{nombre=' || cliente_nombre || ', nacion=' || n_name || '}'",
    "images": "CASE WHEN image IS NULL THEN NULL ELSE '{logo=' || image || '}' END",
    "items": ("[{'item': 'base', 'precio': monto}, {'item': 'impuesto', 'precio': impuesto}]", ["item", "precio"]),
}


def read_template(source: str) -> list[tuple]:
    """(kind, text or name, children) of a template with plain tags only."""
    tokens = re.split(r"(\{\{\{.*?\}\}\}|\{\{.*?\}\})", source, flags=re.S)

    def block(until: str | None) -> list[tuple]:
        out = []
        while tokens:
            t = tokens.pop(0)
            if not t.startswith("{{"):
                if t:
                    out.append(("text", t, []))
                continue
            inner = t.strip("{}").strip()
            name = inner.lstrip("#^/&!").strip()
            if t.startswith("{{{") or inner.startswith("&"):
                out.append(("raw", name, []))
            elif inner.startswith("!"):
                continue
            elif inner.startswith("/"):
                assert name == until
                return out
            elif inner[0] in "#^":
                out.append(("section" if inner[0] == "#" else "inverted", name, block(name)))
            else:
                out.append(("var", name, []))
        return out

    return block(None)


def _esc(e: str) -> str:
    for ch, rep in HTML_ESCAPES:
        e = f"replace({e}, {lit(ch)}, {lit(rep)})"
    return e


def _find(stack: list[dict], name: str):
    for scope in reversed(stack):
        if name in scope:
            return scope[name]
    return None


def _render(nodes, stack: list[dict], depth: int = 0) -> str:
    parts = []
    for kind, value, children in nodes:
        if kind == "text":
            parts.append(lit(value))
            continue
        v = _find(stack, value)
        if kind in ("var", "raw"):
            if v is None or isinstance(v, tuple):
                parts.append("''")
            else:
                parts.append(f"coalesce({_esc(v) if kind == 'var' else v}, '')")
        elif isinstance(v, tuple):  # list section / inverted
            lst, fields = v
            if kind == "inverted":
                parts.append(f"(CASE WHEN len({lst}) = 0 THEN {_render(children, stack, depth)} ELSE '' END)")
            else:
                it = f"it{depth}"
                inner = _render(children, stack + [{f: f"{it}.{f}" for f in fields}], depth + 1)
                parts.append(f"coalesce(array_to_string(list_transform({lst}, lambda {it}: {inner}), ''), '')")
        else:
            truthy = "false" if v is None else f"({v} IS NOT NULL AND {v} <> '')"
            body = _render(children, stack + [{".": v}] if v is not None else stack, depth)
            if kind == "inverted":
                parts.append(f"(CASE WHEN NOT {truthy} THEN {body} ELSE '' END)")
            else:
                parts.append(f"(CASE WHEN {truthy} THEN {body} ELSE '' END)")
    return "(" + " || ".join(parts) + ")" if parts else "''"


def _template_sources() -> dict[str, str]:
    import os

    out = {}
    for root, prefix in [(PACKAGED_ROOT, "templates/")] + [(r, k) for k, r in LANDED_ROOTS.items()]:
        for dirpath, _, files in os.walk(root):
            for f in files:
                full = os.path.join(dirpath, f)
                rel = os.path.relpath(full, root)
                with open(full, encoding="utf-8") as fh:
                    out[(prefix, rel)] = fh.read()
    return out


def html_body() -> str:
    src = _template_sources()
    by_location = {
        "orden.html": src[("templates/", "orden.html")],
        "templates/orden.html": src[("templates/", "orden.html")],
        "reporte.html": src[("templates/", "reporte.html")],
        "s3@plantillas.dev:v1/facturas/factura.html": src[("s3@", "v1/facturas/factura.html")],
        "fs@/srv/plantillas/recibo.html": src[("fs@", "srv/plantillas/recibo.html")],
        "http@https://cdn.example.com/t/aviso.html": src[("http", "cdn.example.com/t/aviso.html")],
    }
    branches = " ".join(
        f"WHEN location = {lit(loc)} THEN {_render(read_template(s), [ROOT_SCOPE])}" for loc, s in by_location.items()
    )
    return f"(CASE {branches} END)"


# A path in the package folder; one in the package root only for formats other than PDF; a landed URI.
FOUND = (
    f"(location IN ('orden.html', 'reporte.html', {', '.join(lit(x) for x in FX.GOOD_LOCATIONS[2:5])}) "
    f"OR location = 'templates/orden.html' AND {resolve_format('output_format')} <> 'pdf')"
)

KEY = "msg_id, output_pos, comp_pos"


def status_sql(select: str, where: str = "") -> str:
    return f"WITH {COMP} SELECT {select} FROM status {where}"


def docs_sql(select: str, where: str = "", tail: str = "") -> str:
    return f"WITH {COMP} SELECT {select} FROM docs {where} {tail}"


def templ_sql(select: str, where: str = "") -> str:
    """Template compositions of every parsed message (no validation)."""
    w = "WHERE kind IN ('OK', 'E3') AND comp_type = 'template'" + (f" AND {where}" if where else "")
    return f"WITH {LINES} SELECT {select} FROM pos {w}"


def uri_sql(*exprs: tuple[str, str], where: str = "") -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in exprs)
    return f"WITH {URIS}, {uri_layers('uris')} SELECT page_id, variant, uri, {cols} FROM l5 {where}"


# ------------------------------------------------------------ Kafka ----

KAFKA = """krec AS (
  SELECT event_id // 10 AS batch_id, event_type AS topic, CAST(user_id % 4 AS BIGINT) AS partition,
    event_id AS "offset", 'request-' || event_id AS key, event_type, user_id,
    '{"evento":"' || event_type || '","valor":"' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) || '","usuario":' || user_id || '}' AS data
  FROM events),
kpos AS (
  SELECT *, CAST(dense_rank() OVER (PARTITION BY batch_id ORDER BY topic || '-' || partition) - 1 AS BIGINT) AS tp_pos,
    CAST(row_number() OVER (PARTITION BY batch_id, topic, partition ORDER BY "offset") - 1 AS BIGINT) AS rec_pos
  FROM krec)"""


def oracle_sql() -> dict[str, str]:
    from ..sources.kafka import CAUSE_BASE64, CAUSE_JSON

    u = "uri"
    s3_rest = "substr(uri, 4)"
    i = f"strpos({s3_rest}, ':')"
    e11 = "printf('Record Topic %s, Key %s, Offset %d: %s', topic, key, \"offset\", " + (
        f"CASE WHEN user_id % 2 = 0 THEN {lit(CAUSE_BASE64)} ELSE {lit(CAUSE_JSON)} END)"
    )
    treq = "SELECT 's3@plantillas.dev:v1/u' || (user_id % 7) || '.html' AS uri, ts, event_id, event_type FROM events"
    fmt_ev = case_pick(FX.FORMAT_CYCLE, f"(event_id % {len(FX.FORMAT_CYCLE)})")
    ev = (
        f"SELECT event_id, ts, {fmt_ev} AS raw_format, {sortable_id('ts', 'CAST(event_id AS VARCHAR)')} AS doc_id FROM events"
    )
    fname = "doc_id || '.' || coalesce(raw_format, 'null')"
    okey = (
        f"{lit(DOCS_PREFIX)} || '/' || strftime(ts, '%Y/%m/%d') || '/' || doc_id || '-' || "
        f"substr(md5(CAST(event_id AS VARCHAR)), 1, 8) || '.' || coalesce(raw_format, 'null')"
    )
    hb = "n"
    human = (
        f"CASE WHEN {hb} < 1024 THEN {hb} || ' B' WHEN {hb} < 1048576 THEN printf('%.1f KB', floor({hb} * 10 / 1024.0 + 0.5) / 10) "
        f"ELSE printf('%.1f MB', floor({hb} * 10 / 1048576.0 + 0.5) / 10) END"
    )
    err_text = (
        "concat_ws(' ', 'Error leyendo /var/data/', d.source, '/archivo.txt:', d.text, p.url)"
    )
    redact = (
        f"regexp_replace(regexp_replace(regexp_replace({err_text}, '/[\\w/.-]+/', '/.../', 'g'), "
        f"'https?://[^\\s]+', 'http://[REDACTED]', 'g'), '\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}', '[IP]', 'g')"
    )
    qmap_keys = "len(list_distinct(list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1))))"
    classify = (
        "CASE WHEN error_code = 'E5' THEN 'INVALID_TEMPLATE_PATH' WHEN error_code = 'E6' THEN 'TEMPLATE_NOT_FOUND' "
        "ELSE 'INVALID_TEMPLATE_DATA' END"
    )
    classify_msg = (
        f"CASE WHEN error_code = 'E5' THEN {lit(E.ERROR_CLASSES['InvalidTemplatePath'][2])} ELSE error_message END"
    )
    classify_status = "CAST(CASE WHEN error_code = 'E6' THEN 404 ELSE 400 END AS BIGINT)"
    location = f"'fs@/temp/' || doc_id || '.' || coalesce(output_format, 'null')"
    catalog_name = "doc_id || '.' || coalesce(output_format, 'null')"
    body = "CASE WHEN format = 'txt' THEN tbody WHEN format = 'html' THEN hbody END"
    size = f"CAST(strlen({body}) AS BIGINT)"
    bodies = f"(SELECT *, {text_body()} AS tbody FROM docs) b"
    bodies_html = f"(SELECT *, {html_body()} AS hbody FROM {bodies}) bb"
    data_keys = "nombre, empresa, monto, fecha, codigo, cantidad, items, cliente, images"
    ctx_keys = "'nombre,empresa,monto,fecha,codigo,cantidad,items,cliente,images' || CASE WHEN image IS NULL THEN '' ELSE ',imagen_logo' END"
    sizes_union = (
        "SELECT doc_id AS id, CAST(v AS BIGINT) AS variant, n FROM (SELECT doc_id, unnest(range(3)) AS v, "
        "unnest([n_chars, n_chars * 1024, n_chars * 1000 + 7]) AS n FROM documents) "
        "UNION ALL SELECT page_id AS id, CAST(3 AS BIGINT) AS variant, CAST(strlen(html) AS BIGINT) AS n FROM pages"
    )
    les = [512, 1024, 2048, 4096, 8192]
    hist = " UNION ALL ".join(
        f"SELECT '{le}' AS le, count(*) FILTER (WHERE sz <= {le}) AS documents FROM sized" for le in les
    ) + " UNION ALL SELECT '+Inf' AS le, count(sz) AS documents FROM sized"
    sized = f"sized AS (SELECT {size} AS sz FROM {bodies_html})"

    local = f"CASE WHEN format <> 'pdf' THEN {location} END"
    event_body = (
        f"md5(repeat('=', 60) || {NL} || 'PLAIN TEXT DOCUMENT GENERATOR' || {NL} || repeat('=', 60) || {NL} || {NL} || 'Template: orden.html' || {NL} || {NL} || "
        f"'Data:' || {NL} || repeat('-', 60) || {NL} || " + " || ".join(f"printf('%-20s : %s', {lit(k)}, {v}) || {NL}" for k, v in (
            ("evento", "event_type"), ("valor", "CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)"), ("usuario", "CAST(user_id AS VARCHAR)"))
        ) + f" || repeat('-', 60) || {NL})"
    )
    # echoed message: every composition of a successful one, static ones too
    echo = (
        f"WITH {COMP} SELECT c.msg_id, c.output_pos, c.comp_pos, c.msg_id AS meta_id, strftime(o.o_orderdate, '%Y-%m-%d') AS meta_fecha, "
        "o.o_custkey AS cliente_id, 'tpch' AS producto, c.priority AS subproducto, c.l_orderkey AS orden, CAST(NULL AS VARCHAR) AS callback, "
        "c.output_type, 'plantilla' AS template, c.comp_type, c.output_format, c.location AS template_path, "
        + ", ".join(f"CASE WHEN c.l_quantity <> 50 THEN {v} END AS {k}" for k, v in (
            ("nombre", "c.c_name"), ("monto", "c.monto"), ("cantidad", "CAST(c.cantidad AS BIGINT)"), ("impuesto", "c.impuesto"), ("nacion", "c.n_name"), ("logo", "c.image")))
        + ", CASE WHEN c.comp_type = 'template' AND c.format <> 'pdf' THEN 'fs@/temp/' || d.doc_id || '.' || coalesce(c.output_format, 'null') END AS result_location "
        "FROM comp2 c JOIN status s ON c.msg_id = s.msg_id JOIN orders o ON o.o_orderkey = c.l_orderkey "
        "LEFT JOIN docs d ON d.msg_id = c.msg_id AND d.output_pos = c.output_pos AND d.comp_pos = c.comp_pos WHERE s.error_code IS NULL"
    )
    turns = "(SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations) t"
    js = lambda x: f"to_json({x})"

    def deep(null_text):
        lista = f"'[{{\"lista\":[{{\"lista\":\"' || turn || '\"}},{{\"lista\":[{{\"lista\":' || {js('role')} || '}}]}}]}},{{\"y\":' || {js('role')} || '}},{{\"lista\":\"{null_text}\"}}]'"
        pairs = (("hoja", "text"), ("n", "turn || '.5'"), ("lista", lista), ("nada", lit(null_text)), ("ok", "'true'"))
        return " UNION ALL ".join(f"SELECT conv_id, turn, {lit(k)} AS name, {v} AS value FROM {turns}" for k, v in pairs)

    def ctx_rows(null_text):
        items = (
            "'[{\"item\":\"base\",\"precio\":\"' || monto || '\"},{\"item\":\"impuesto\",\"precio\":\"' || impuesto || '\"}]'"
        )
        pairs = [
            ("nombre", "cliente_nombre"), ("empresa", "c_mktsegment"), ("monto", "monto"), ("fecha", "fecha"),
            ("codigo", "codigo"), ("cantidad", "cantidad"), ("items", items), ("nacion", "n_name"),
        ]
        sel = " UNION ALL ".join(f"SELECT {KEY}, {lit(k)} AS name, {v} AS value FROM d" for k, v in pairs)
        img = (
            f" UNION ALL SELECT {KEY}, 'logo' AS name, image AS value FROM d WHERE image IS NOT NULL"
            f" UNION ALL SELECT {KEY}, 'images' AS name, {lit(null_text)} AS value FROM d WHERE image IS NULL"
        )
        return f"WITH {COMP}, d AS (SELECT * FROM docs WHERE format = 'pdf') {sel}{img}"

    def b64_bytes(v):
        """The payload's bytes in canonical base64."""
        try:
            return base64.b64encode(base64.b64decode(v + "=" * (-len(v) % 4), validate=True)).decode()
        except Exception:
            return None

    logo = case_pick([None if v is None else b64_bytes(v) for v in FX.IMAGE_CYCLE], f"(l_partkey % {len(FX.IMAGE_CYCLE)})")

    st2 = (
        f"WITH RECURSIVE r AS (SELECT uri, ts, row_number() OVER (PARTITION BY uri ORDER BY ts, event_id) AS rn FROM ({treq})), "
        "chain AS (SELECT uri, rn, ts, ts AS entry, true AS fetched FROM r WHERE rn = 1 "
        "UNION ALL SELECT r.uri, r.rn, r.ts, "
        "CASE WHEN epoch_us(r.ts) - epoch_us(c.entry) >= 7200000000 THEN r.ts ELSE c.entry END, "
        "epoch_us(r.ts) - epoch_us(c.entry) >= 7200000000 FROM chain c JOIN r ON r.uri = c.uri AND r.rn = c.rn + 1) "
        f"SELECT uri, {ts_text('ts')} AS ts, fetched, {ts_text('entry')} AS entry_at FROM chain"
    )
    obj_key = f"'{DOCS_PREFIX}/2024/02/01/' || doc_id || '-' || substr(md5(doc_id), 1, 8) || '.' || coalesce(output_format, 'null')"

    return {
        "st1_run_stream": (
            "SELECT event_type AS topic, CAST(user_id % 4 AS BIGINT) AS partition, event_id AS \"offset\", "
            "event_type = 'purchase' AS ok, CASE WHEN event_type = 'purchase' THEN NULL WHEN event_type = 'error' THEN 'E11' "
            f"ELSE 'E1' END AS error_code, CASE WHEN event_type = 'purchase' THEN {event_body} END AS body, "
            "CASE WHEN event_type = 'purchase' THEN true END AS responded, CASE WHEN event_type <> 'purchase' THEN true END AS failed, "
            "count(*) OVER () AS processed, CAST(count(*) FILTER (event_type = 'purchase') OVER () AS BIGINT) AS success, "
            "CAST(count(*) FILTER (event_type <> 'purchase') OVER () AS BIGINT) AS failure FROM events"
        ),
        "st4_delivery": (
            "WITH e AS (SELECT CAST(event_id % 4 AS BIGINT) AS batch_id, event_type || ':' || (user_id % 4) || ':' || event_id AS msg_id, event_type = 'purchase' AS ok FROM events) "
            "SELECT batch_id, msg_id, kind, CAST(1 AS BIGINT) AS times FROM e, (VALUES ('result', NULL), ('document', true), ('catalog', true), ('response', true), ('failure', false)) AS v(kind, want) "
            "WHERE want IS NULL OR want = ok"
        ),
        "a1_batch_errors": (
            f"WITH {KAFKA}, r AS (SELECT CAST(batch_id % 3 AS BIGINT) AS batch_id, topic, partition, \"offset\", CASE WHEN event_type = 'error' THEN {e11} "
            f"WHEN event_type <> 'purchase' THEN {lit(E.E1_NO_ITEM)} END AS error FROM kpos), "
            "s AS (SELECT batch_id, count(*) AS processed, count(*) FILTER (error IS NULL) AS success, count(*) FILTER (error IS NOT NULL) AS failure FROM r GROUP BY batch_id) "
            "SELECT s.*, topic, partition, \"offset\", error FROM s LEFT JOIN (SELECT * FROM r WHERE error IS NOT NULL) USING (batch_id)"
        ),
        "st2_template_fetch_state": st2,
        "st2_fetch_state_stream": st2,
        "sk1_write_documents": (
            f"WITH {COMP}, b AS (SELECT *, {body} AS body, format <> 'pdf' AS stored FROM {bodies_html}) "
            f"SELECT {KEY}, CASE WHEN stored THEN {obj_key} END AS object_key, CASE WHEN stored THEN 's3@:{DOCS_BUCKET}/' || {obj_key} END AS repository_path, "
            f"CASE WHEN stored THEN md5(body) END AS body, CASE WHEN stored THEN 's3@:{DOCS_BUCKET}/' || {obj_key} ELSE {local} END AS result_location FROM b"
        ),
        "sk2_write_local_copy": f"WITH {COMP} SELECT {KEY}, {location} AS result_location, md5({body}) AS body FROM {bodies_html} WHERE format <> 'pdf'",
        "sk3_write_responses": status_sql("CAST(NULL AS VARCHAR) AS key, msg_id", "WHERE error_code IS NULL"),
        "sk4_write_responses_keyed": f"SELECT msg_id, output_pos, comp_pos, meta_id, nombre, result_location FROM ({echo})",
        "rs6_flatten_deep": deep(""),
        "rs8_flatten_deep": deep("null"),
        "rn8_text_deep": (
            f"SELECT conv_id, turn, repeat('=', 60) || {NL} || 'PLAIN TEXT DOCUMENT GENERATOR' || {NL} || repeat('=', 60) || {NL} || {NL} || 'Template: orden.html' || {NL} || {NL} || "
            f"'Data:' || {NL} || repeat('-', 60) || {NL} || " + " || ".join(f"rpad({lit(k)}, 20, ' ') || ' : ' || {v} || {NL}" for k, v in (
                ("hoja", "'primera'"), ("a", "'{b={c={d={e={f={g={hoja=' || text || ', n=' || turn || '.5}}}}}}}'"),
                ("lista", "'[[' || turn || ', [' || role || ']], {x={y=' || role || '}}, null]'"), ("nada", "'null'"), ("ok", "'true'"))
            ) + f" || repeat('-', 60) || {NL} AS body FROM {turns}"
        ),
        "rn4_text_kinds": (
            "SELECT conv_id, turn, 'L:' || " + _esc("('[urgente] ' || role)") + " || ';F:false;N{' || turn || '}[urgente] ' || role || '|[]' AS body " f"FROM {turns}"
        ),
        "v3_data_kinds": (
            f"SELECT conv_id || '-' || turn AS msg_id, turn % 4 = 0 AS ok, CASE turn % 4 WHEN 1 THEN 'E4b' WHEN 2 THEN 'E4b' WHEN 3 THEN 'E4' END AS error_code, "
            f"CASE turn % 4 WHEN 1 THEN {lit(E.DATA_NOT_OBJECT)} WHEN 2 THEN {lit(E.DATA_NOT_OBJECT)} WHEN 3 THEN {lit(E.E4_EMPTY_DATA)} END AS error_message FROM {turns}"
        ),
        "rs4_image_kinds": (
            f"SELECT conv_id, turn, CAST(CASE turn % 5 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS BIGINT) AS n_images, CASE turn % 5 WHEN 0 THEN 'y' WHEN 3 THEN 'z' END AS logo FROM {turns}"
        ),
        "rn6_many_templates": (
            "SELECT 'p' || page_id AS msg_id, page_id % 10 <> 3 AS ok, CASE WHEN page_id % 10 = 3 THEN 'E8' END AS error_code, "
            "CASE WHEN page_id % 10 = 3 THEN 'Failed to generate HTML document: Failed to close ''lista'' tag' END AS error_message, "
            "CASE WHEN page_id % 10 <> 3 THEN '<h1>' || " + _esc("coalesce(url, '')") + " || '</h1><li>' || page_id || '</li><li>a&amp;b</li><p>P' || page_id || ' ' || coalesce(url, '') || '</p>' END AS body FROM pages"
        ),
        "rs6_flatten_context": ctx_rows(""),
        "rs8_flatten_context_json": ctx_rows("null"),
        "rn7_pdf_context": (
            f"SELECT c.msg_id, c.output_pos, c.comp_pos, c.context, CASE WHEN d.image IS NULL THEN '' ELSE 'image_pr_logo' END AS images, "
            f"{logo} AS logo FROM "
            f"(SELECT {KEY}, string_agg(name || '=' || value, ';' ORDER BY name) AS context FROM ({ctx_rows('')}) GROUP BY {KEY}) c "
            f"JOIN ({docs_sql('*')}) d ON d.msg_id = c.msg_id AND d.output_pos = c.output_pos AND d.comp_pos = c.comp_pos"
        ),
        "fn01_resolve_format": (
            f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, raw_format, {resolve_format('raw_format')} AS format, "
            f"CASE {resolve_format('raw_format')} WHEN 'pdf' THEN 'application/pdf' WHEN 'html' THEN 'text/html' ELSE 'text/plain' END AS mime, "
            f"{resolve_format('raw_format')} AS extension "
            f"FROM (SELECT l.*, {FORMAT} AS raw_format FROM lineitem l)"
        ),
        "fn03_has_protocol": uri_sql(("has_protocol", has_protocol(u))),
        "fn04_is_local": uri_sql(("is_local", f"(NOT {is_blank(u)} AND NOT {has_protocol(u)})")),
        "fn05_template_protocol": uri_sql(("protocol", protocol(u))),
        "fn06_parse_s3_uri": uri_sql(
            ("host", f"CASE WHEN starts_with(uri, 's3@') AND {i} > 0 THEN substr({s3_rest}, 1, {i} - 1) END"),
            ("key", f"CASE WHEN starts_with(uri, 's3@') AND {i} > 0 THEN substr({s3_rest}, {i} + 1) END"),
            ("ok", f"coalesce(starts_with(uri, 's3@') AND {i} > 0, false)"),
        ),
        "fn07_strip_protocol": uri_sql(("stripped",
            "CASE WHEN starts_with(uri, 'fs@') THEN substr(uri, 4) WHEN starts_with(uri, 'http@') THEN substr(uri, 6) "
            "WHEN starts_with(uri, 'https@') THEN substr(uri, 7) ELSE uri END")),
        "fn08_path_after_colon": uri_sql(("path",
            f"CASE WHEN {is_blank(u)} THEN '' WHEN strpos(uri, ':') > 0 AND strpos(uri, ':') < length(uri) "
            f"THEN substr(uri, strpos(uri, ':') + 1) ELSE uri END")),
        "fn09_cache_key": uri_sql(("cache_key", "md5(uri) || regexp_extract(uri, '(\\.[^./]*)$', 1)")),
        "fn10_sortable_id": f"SELECT event_id, doc_id FROM ({ev})",
        "fn11_document_filename": f"SELECT event_id, {fname} AS file_name FROM ({ev})",
        "fn12_local_location": f"SELECT event_id, 'fs@/temp/' || {fname} AS location FROM ({ev})",
        "fn13_object_key": f"SELECT event_id, {okey} AS object_key, 's3@:' || {lit(DOCS_BUCKET)} || '/' || {okey} AS location FROM ({ev})",
        "fn14_file_extension": uri_sql(("ext", file_ext(u))),
        "fn15_file_extension_simple": uri_sql(("ext", f"CASE WHEN {last_index(u, '.')} > 0 THEN substr(uri, {last_index(u, '.')} + 2) ELSE '' END")),
        "fn16_content_type": uri_sql(("content_type", content_type(u))),
        "fn17_sanitize_path": uri_sql(("name", sanitize_path(u))),
        "fn18_sanitize_template_path": uri_sql(("name", "template_name")),
        "fn19_sanitize_s3_uri": uri_sql(("name", "s3_name")),
        "fn20_sanitize_http_url": uri_sql(("name", "http_name")),
        "fn21_sanitize_map": (
            f"SELECT page_id, CASE WHEN NOT contains(url, '?') THEN 'null' WHEN {qmap_keys} = 0 THEN '{{empty}}' "
            f"ELSE '{{' || {qmap_keys} || ' fields}}' END AS fields FROM pages"
        ),
        "fn22_human_bytes": f"SELECT id, variant, n, {human} AS text FROM ({sizes_union})",
        "fn23_sanitize_bucket": (
            "SELECT doc_id, CASE WHEN lang = 'en' OR source IS NULL OR source = '' THEN '[empty]' ELSE '[S3_BUCKET]' END AS bucket FROM documents"
        ),
        "fn24_file_name_of": uri_sql(("name", file_name_of(u))),
        "fn25_sanitize_error_message": f"SELECT d.doc_id, {redact} AS message FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id",
        "fn26_request_summary": (
            f"WITH {COMP} SELECT {KEY}, 'TemplateRequest{{templatePath=''' || location || ''', dataKeys=[{data_keys}], imageKeys=' || "
            f"CASE WHEN image IS NULL THEN '[]' ELSE '[logo]' END || ', isPersist=false}}' AS summary "
            f"FROM comp2 WHERE comp_type = 'template' AND msg_id NOT IN (SELECT msg_id FROM first_map) AND kind = 'OK'"
        ),
        "fn27_template_file_name": uri_sql(("name", (
            lambda bare: (
                f"CASE WHEN {is_empty(u)} THEN '[unknown]' "
                f"WHEN greatest({last_index(bare, '/')}, {last_index(bare, chr(92))}) >= 0 "
                f"AND greatest({last_index(bare, '/')}, {last_index(bare, chr(92))}) < length({bare}) - 1 "
                f"THEN substr({bare}, greatest({last_index(bare, '/')}, {last_index(bare, chr(92))}) + 2) ELSE {bare} END"
            )
        )(f"(CASE WHEN contains(uri, '@') AND strpos(uri, ':') > 0 AND strpos(uri, ':') < length(uri) THEN substr(uri, strpos(uri, ':') + 1) ELSE uri END)"))),
        "fn28_cache_age": (
            f"SELECT event_id, printf('%dh %dm', d // 3600000000, (d // 60000000) % 60) AS age "
            f"FROM (SELECT event_id, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) AS d FROM events)"
        ),
        "fn29_safe_name_fallback": uri_sql(("name", "regexp_replace(uri, '[^a-zA-Z0-9._-]', '_', 'g')")),
        "so1_read_messages": (
            f"WITH {LINES} SELECT msg_id, true AS parsed_ok, any_value(kind) <> 'E1' AS has_item, "
            f"CAST(CASE any_value(kind) WHEN 'E1' THEN 0 WHEN 'E2' THEN 0 WHEN 'E3' THEN count(DISTINCT l_linestatus) + 1 "
            f"ELSE count(DISTINCT l_linestatus) END AS BIGINT) AS outputs FROM pos GROUP BY msg_id"
        ),
        "so2_explode_kafka_batch": f"WITH {KAFKA} SELECT batch_id, tp_pos, rec_pos, topic, partition, \"offset\", key FROM kpos",
        "so3_decode_record": (
            f"WITH {KAFKA} SELECT batch_id, \"offset\", event_type <> 'error' AS decode_ok, "
            f"CASE WHEN event_type = 'error' THEN {e11} END AS decode_error, "
            "CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN NULL WHEN event_type = 'error' THEN '{bad json' "
            "WHEN event_type = 'purchase' THEN '{\"metadata\":{\"id\":' || \"offset\" || '},\"data\":{\"item_canonico\":{\"outputs\":[{\"type\":\"evento\",\"composicion\":"
            "[{\"type\":\"template\",\"metadata\":{\"resource\":{\"output_format\":\"txt\",\"location\":\"orden.html\",\"data\":' || data || '}}}]}]}}}' "
            "ELSE '{\"templatePath\":\"orden.html\",\"data\":' || data || '}' END AS raw FROM kpos"
        ),
        "so3_decode_bytes": (
            "SELECT event_type AS topic, CAST(user_id % 4 AS BIGINT) AS partition, event_id AS \"offset\", true AS base64_ok, raw AS from_base64, true AS decode_ok, raw FROM ("
            "SELECT *, '{\"metadata\":{\"id\":' || event_id || '},\"nota\":\"' || CASE event_id % 4 WHEN 0 THEN 'ñ' WHEN 2 THEN chr(65533) || '(' ELSE chr(65533) END || '\"}' AS raw FROM events)"
        ),
        "so4_decode_binary": (
            "SELECT event_type AS topic, CAST(user_id % 4 AS BIGINT) AS partition, event_id AS \"offset\", "
            "CASE event_id % 2 WHEN 0 THEN 'CREATE_TIME' ELSE 'LOG_APPEND_TIME' END AS \"timestampType\", 'request-' || event_id AS key, CAST(1 AS BIGINT) AS headers, "
            "event_type <> 'error' AS decode_ok, CASE WHEN event_type = 'error' THEN printf('Record Topic %s, Key %s, Offset %d: %s', event_type, "
            f"'request-' || event_id, event_id, {lit(CAUSE_JSON)}) END AS decode_error, "
            "CASE WHEN event_type = 'error' THEN '{bad json' ELSE '{\"metadata\":{\"id\":' || event_id || ',\"nota\":\"' || repeat('ñandú ', 20) || '\"}}' END AS raw FROM events"
        ),
        "so4_read_offsets": (
            "SELECT event_type AS topic, CAST(user_id % 4 AS BIGINT) AS partition, event_id AS \"offset\", 'request-' || event_id  AS key, epoch_us(ts) // 1000 AS timestamp, "
            "CASE event_id % 2 WHEN 0 THEN 'CREATE_TIME' ELSE 'LOG_APPEND_TIME' END AS \"timestampType\", event_type <> 'error' AS decode_ok, "
            "md5(CASE WHEN event_type = 'error' THEN '{bad json' ELSE '{\"metadata\":{\"id\":' || event_id || ',\"nota\":\"' || repeat('ñandú ', 20) || '\"}}' END) AS value FROM events"
        ),
        "so6_land_templates": (
            "WITH r(round, n) AS (VALUES ('2024-02-01 08:00:00', 1), ('2024-02-01 09:00:00', 2), ('2024-02-01 10:30:00', 3)), "
            "a AS (SELECT page_id, url, round, n, page_id % 3 <> 0 AND page_id % 5 <> 0 AS first, page_id % 10 <> 0 AS b FROM pages, r WHERE n > 1 OR page_id % 3 <> 0), "
            # Round 1 reads mount A, the others B; a copy of round 1 is fresh in round 2 and gone in round 3, one of round 2 is fresh in round 3.
            "f AS (SELECT *, CASE n WHEN 1 THEN true WHEN 2 THEN NOT first ELSE first OR NOT b END AS fetched, CASE WHEN n = 1 THEN page_id % 5 <> 0 ELSE b END AS there FROM a) "
            "SELECT page_id, round, fetched, CASE WHEN fetched AND NOT there THEN "
            f"{lit(E.E6_NOT_FOUND % (E.E6_DOWNLOAD_FAILED % 'Source file not found: '))} || page_id || '.html' END AS error, "
            "md5(CASE WHEN n = 1 AND there OR n = 2 AND first THEN 'A:' || coalesce(url, '') WHEN there THEN 'B:' || coalesce(url, '') END) AS content FROM f"
        ),
        "v1_check_structure": (
            f"WITH {LINES} SELECT DISTINCT msg_id, CASE kind WHEN 'E1' THEN 'E1' WHEN 'E2' THEN 'E2' END AS error_code, "
            f"CASE kind WHEN 'E1' THEN {lit(E.E1_NO_ITEM)} WHEN 'E2' THEN {lit(E.E2_NO_OUTPUTS)} END AS error_message FROM pos"
        ),
        "v2_check_composition": (
            f"WITH {LINES} SELECT msg_id, CAST(count(DISTINCT l_linestatus) AS BIGINT) AS output_pos, "
            f"{lit(E.E3_NO_COMPOSITION % 'anexo')} AS error_message FROM pos WHERE kind = 'E3' GROUP BY msg_id"
        ),
        "v3_check_data_node": templ_sql(
            f"{KEY}, CASE WHEN l_quantity = 50 THEN 'E4' WHEN {path_unsafe('location')} THEN 'E5' END AS error_code, "
            f"CASE WHEN l_quantity = 50 THEN {lit(E.E4_EMPTY_DATA)} WHEN {path_unsafe('location')} THEN {e5_message('location')} END AS error_message"
        ),
        "v4_template_path": uri_sql(("unsafe", path_unsafe(u)), ("error_message", f"CASE WHEN {path_unsafe(u)} THEN {e5_message(u)} END")),
        "v5_check_image_payload": templ_sql(f"{KEY}, CASE WHEN l_quantity <> 50 AND image = '!!notbase64' THEN 'E7' END AS error_code"),
        "v7_check_protocol": uri_sql(("error_message",
            f"CASE WHEN {has_protocol(u)} AND {protocol(u)} IS NULL THEN "
            f"'Template not found: Failed to download template: No downloader found for URI: ' || uri || "
            f"'. Supported protocols: [s3@, fs@, http]' END")),
        "v8_check_result_counts": (
            f"WITH {COMP}, n AS (SELECT msg_id, count(*) AS templates, count(*) FILTER (NOT (l_orderkey % 7 = 0 AND comp_pos = 1)) "
            "+ count(*) FILTER (l_orderkey % 11 = 0 AND comp_pos = 0) AS results FROM docs GROUP BY msg_id) "
            f"SELECT msg_id, templates, CAST(results AS BIGINT) AS results, 'E9' AS error_code, printf({lit(E.E9_RESULTS_COUNT)}, results, templates) AS error_message FROM n WHERE templates <> results"
        ),
        "v9_message_status": status_sql("msg_id, error_code IS NULL AS ok, error_code, error_message"),
        "v10_classify_error": status_sql(
            f"msg_id, {classify} AS error, {classify_msg} AS message, {classify_status} AS status", "WHERE error_code IS NOT NULL"
        ),
        "sk5_failures": status_sql("msg_id, error_code, error_message", "WHERE error_code IS NOT NULL"),
        "a1_batch_summary": status_sql(
            "count(*) AS processed, count(*) FILTER (WHERE error_code IS NULL) AS success, "
            "count(*) FILTER (WHERE error_code IS NOT NULL) AS failure"
        ),
        "rs1_flatten_outputs": (
            f"WITH {LINES} SELECT {KEY}, output_type, comp_type, location, output_format FROM pos WHERE kind IN ('OK', 'E3')"
        ),
        "rs2_only_templates": templ_sql(f"{KEY}, location, output_format"),
        "rs3_project_request": templ_sql(f"{KEY}, location AS template_path, output_format AS file_type, l_quantity <> 50 AS has_data, false AS persist"),
        "rs4_extract_images": templ_sql(
            f"{KEY}, CAST(CASE WHEN l_quantity <> 50 AND image IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS n_images, "
            f"CASE WHEN l_quantity <> 50 THEN image END AS logo"
        ),
        "rs5_request_profile": (
            f"WITH {LINES}, t AS (SELECT * FROM pos WHERE kind IN ('OK', 'E3') AND comp_type = 'template'), "
            f"{uri_layers('t', 'location')} SELECT {KEY}, template_name, output_format AS file_type, "
            f"CAST(CASE WHEN l_quantity = 50 THEN 0 ELSE 9 END AS BIGINT) AS data_fields, "
            f"(l_quantity <> 50 AND image IS NOT NULL) AS has_images, false AS persist FROM l5"
        ),
        "rs10_collate_results": echo,
        "rs13_request_from_flat": f"WITH {LINES} SELECT DISTINCT msg_id, 'orden.html' AS template_path, true AS is_local FROM pos WHERE kind = 'E1'",
        "j1_resolve_templates": templ_sql(f"{KEY}, location AS template_path, {resolve_format('output_format')} AS format, coalesce({FOUND}, false) AS template_found"),
        "j2_missing_templates": templ_sql(f"{KEY}, location AS template_path", f"NOT coalesce({FOUND}, false)"),
        "j3_requested_templates": (
            f"WITH {LINES} SELECT DISTINCT location AS uri, {protocol('location')} AS protocol, "
            f"md5(location) || regexp_extract(location, '(\\.[^./]*)$', 1) AS cache_key FROM pos "
            f"WHERE kind IN ('OK', 'E3') AND comp_type = 'template' AND contains(location, '@')"
        ),
        "a5_distinct_protocols": (
            f"WITH {LINES} SELECT DISTINCT {protocol('location')} AS protocol FROM pos "
            f"WHERE kind IN ('OK', 'E3') AND comp_type = 'template' AND contains(location, '@')"
        ),
        "j5_fresh_cache_lookup": (
            f"WITH r AS ({treq}), c AS (SELECT uri, ts AS fetched_at FROM r WHERE event_type = 'signup') "
            f"SELECT r.event_id, r.uri, {ts_text('max(c.fetched_at)')} AS entry_at FROM r LEFT JOIN c ON r.uri = c.uri "
            f"AND c.fetched_at <= r.ts AND epoch_us(r.ts) - epoch_us(c.fetched_at) < 7200000000 GROUP BY r.event_id, r.uri"
        ),
        "st3_evict_expired": (
            f"SELECT uri, {ts_text('ts')} AS fetched_at, event_id FROM ({treq}) WHERE epoch_us(ts) > (SELECT max(epoch_us(ts)) FROM events) - 7200000000"
        ),
        "a2_record_count": "SELECT event_id // 10 AS batch_id, count(*) AS records FROM events GROUP BY 1",
        "a3_outputs_per_message": (
            f"WITH {LINES} SELECT msg_id, CAST(CASE any_value(kind) WHEN 'E1' THEN 0 WHEN 'E2' THEN 0 "
            f"WHEN 'E3' THEN count(DISTINCT l_linestatus) + 1 ELSE count(DISTINCT l_linestatus) END AS BIGINT) AS outputs FROM pos GROUP BY msg_id"
        ),
        "a4_requests_per_message": f"WITH {LINES} SELECT msg_id, count(*) AS requests FROM pos WHERE kind IN ('OK', 'E3') AND comp_type = 'template' GROUP BY msg_id",
        "a6_documents_by_format": (
            "WITH " + COMP + " SELECT format, CASE WHEN format = 'pdf' THEN 'needs_converter' ELSE 'rendered' END AS status, "
            "count(*) AS documents FROM docs GROUP BY 1, 2"
        ),
        "a7_size_histogram": f"WITH {COMP}, {sized} {hist}",
        "a7_render_duration": (
            f"WITH {COMP}, {sized} SELECT kind, name, true AS holds, CASE WHEN name = '+Inf' THEN (SELECT count(sz) FROM sized) END AS documents FROM (VALUES "
            + ", ".join(f"('bucket', '{le}')" for le in (50, 100, 250, 500, 1000, 5000, 25000, 100000, "+Inf")) + ", "
            + ", ".join(f"('quantile', '{q}')" for q in ("0.5", "0.95", "0.99")) + ") AS v(kind, name)"
        ),
        "a8_catalog_search": docs_sql(
            f"{KEY}, {catalog_name} AS original_filename, CAST(strlen({text_body()}) AS BIGINT) AS file_size",
            "WHERE output_format = 'txt'",
        ),
        "rn1_html_context": docs_sql(f"{KEY}, {ctx_keys} AS context_keys, data_uri AS imagen_logo", "WHERE format = 'html'"),
        "rn2_image_mime": templ_sql(
            f"{KEY}, regexp_extract(data_uri, '^data:([^;]*);', 1) AS mime, data_uri", "l_quantity <> 50 AND image IS NOT NULL"
        ),
        "rn6_render_html": f"WITH {COMP} SELECT {KEY}, location AS template_path, hbody AS body FROM {bodies_html} WHERE format = 'html'",
        "rn8_render_text": docs_sql(f"{KEY}, location AS template_path, {text_body()} AS body", "WHERE format = 'txt'"),
        "rn10_render_report": f"WITH {COMP} SELECT location AS template_path, count(*) AS documents, CAST(sum({size}) AS BIGINT) AS bytes FROM {bodies_html} GROUP BY 1",
        "rn11_generate_documents": (
            f"WITH {COMP}, n AS (SELECT msg_id, count(*) FILTER (format <> 'pdf') AS documents, count(*) FILTER (format = 'pdf') AS pending, "
            f"md5(string_agg(CASE WHEN format = 'pdf' THEN '' ELSE {location} || ' ' || md5({body}) END, '|' ORDER BY output_pos, comp_pos)) AS bodies FROM {bodies_html} GROUP BY 1) "
            "SELECT s.msg_id, s.error_code IS NULL AS ok, s.error_code, CAST(coalesce(n.documents, 0) AS BIGINT) AS documents, CAST(coalesce(n.pending, 0) AS BIGINT) AS pending, "
            "CASE WHEN s.error_code IS NULL THEN CAST(coalesce(n.documents, 0) AS BIGINT) END AS locations, n.bodies FROM status s LEFT JOIN n ON s.msg_id = n.msg_id"
        ),
        "sk6_document_catalog": (
            f"WITH {COMP} SELECT {KEY}, {catalog_name} AS original_filename, {size} AS file_size, '2024-02-01' AS generated_date, "
            f"CASE WHEN {file_ext(catalog_name)} <> '' THEN {file_ext(catalog_name)} END AS file_type, "
            f"{content_type(catalog_name)} AS content_type FROM {bodies_html} WHERE format <> 'pdf'"
        ),
    }
