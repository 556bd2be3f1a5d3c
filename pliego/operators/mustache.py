"""RN3-RN6: Mustache templates. A template is parsed once per task and bound to
a data node at a time, inside an Arrow-batched UDF (``operators/render.py``).

Tags: ``{{name}}`` (HTML-escaped), ``{{{name}}}`` and ``{{&name}}`` (raw),
``{{#name}}..{{/name}}`` (section), ``{{^name}}..{{/name}}`` (inverted),
``{{! comment}}``, ``{{=<% %>=}}`` (other delimiters), dotted names and
``{{.}}``. Text is emitted as written (no standalone-line trimming). A partial
names a template file that a request does not carry, so a template with one is
in error, like an unbalanced section; the error is data, nothing raises.

Sections: missing, null, false, empty text and empty lists are falsy; a list
repeats its body per element with the element on top of the scope stack; any
other value renders the body once with the value on top. Names resolve from the
top of the stack down, so an inner name that an item lacks is found in the
parent (which makes a section nested in itself repeat N x N times).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .jsontext import java_text

# The HTML escape table, and control chars 0..13 as numeric references.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("`", "&#96;"), ("=", "&#61;")]
CONTROL_MAX = 13

_ESCAPE = str.maketrans({**dict(HTML_ESCAPES), **{chr(i): f"&#{i};" for i in range(CONTROL_MAX + 1)}})


@dataclass
class Node:
    kind: str  # text | var | raw | section | inverted
    value: str = ""
    children: list[Node] = field(default_factory=list)


class TemplateError(ValueError):
    pass


def parse(source: str) -> list[Node]:
    """Template text -> AST. Raises TemplateError where a tag or section is not
    closed, a section closes another's name, or a partial is used."""
    root: list[Node] = []
    stack: list[tuple[str, list[Node]]] = [("", root)]
    left, right = "{{", "}}"
    pos = 0
    while True:
        at = source.find(left, pos)
        if at < 0:
            break
        if at > pos:
            stack[-1][1].append(Node("text", source[pos:at]))
        begin = at + len(left)
        sigil = source[begin : begin + 1]
        end = {"{": "}" + right, "=": "=" + right}.get(sigil, right)
        close = source.find(end, begin + 1 if sigil in "{=" else begin)
        if close < 0:
            raise TemplateError(f"Improperly closed variable at offset {at}")
        inner = source[begin:close]
        pos = close + len(end)
        name = inner[1:].strip()
        if sigil == "{":
            stack[-1][1].append(Node("raw", name))
        elif sigil == "&":
            stack[-1][1].append(Node("raw", name))
        elif sigil == "=":
            marks = name.split()
            if len(marks) != 2:
                raise TemplateError(f"Invalid delimiters: {name}")
            left, right = marks
        elif sigil == "!" or not inner.strip():
            continue
        elif sigil in "#^":
            node = Node("section" if sigil == "#" else "inverted", name)
            stack[-1][1].append(node)
            stack.append((name, node.children))
        elif sigil == "/":
            if len(stack) == 1 or stack[-1][0] != name:
                raise TemplateError(f"Mismatched start/end tags: {stack[-1][0] or 'none'} != {name}")
            stack.pop()
        elif sigil == ">":
            raise TemplateError(f"Template {name} not found")
        else:
            stack[-1][1].append(Node("var", inner.strip()))
    if len(stack) != 1:
        raise TemplateError(f"Failed to close '{stack[-1][0]}' tag")
    if pos < len(source):
        root.append(Node("text", source[pos:]))
    return root


def template_error(source: str) -> str | None:
    """Why a template cannot be parsed, or None."""
    try:
        parse(source)
    except TemplateError as e:
        return str(e)
    return None


def _find(stack: list, name: str):
    if name == ".":
        return stack[-1]
    head, *rest = name.split(".")
    for scope in reversed(stack):
        if isinstance(scope, dict) and scope.get(head) is not None:
            found = scope[head]
            for part in rest:
                found = found.get(part) if isinstance(found, dict) else None
            return found
    return None


def _truthy(v) -> bool:
    return not (v is None or v is False or (isinstance(v, (str, list)) and not len(v)))


def _write(nodes: list[Node], stack: list, out: list[str]) -> None:
    for n in nodes:
        if n.kind == "text":
            out.append(n.value)
            continue
        v = _find(stack, n.value)
        if n.kind == "section":
            if isinstance(v, list):
                for item in v:
                    _write(n.children, [*stack, item], out)
            elif _truthy(v):
                _write(n.children, [*stack, v], out)
        elif n.kind == "inverted":
            if not _truthy(v):
                _write(n.children, stack, out)
        elif v is not None:
            text = java_text(v)
            out.append(text.translate(_ESCAPE) if n.kind == "var" else text)


def bind(nodes: list[Node], context: dict) -> str:
    """A parsed template with a context's values."""
    out: list[str] = []
    _write(nodes, [context], out)
    return "".join(out)
