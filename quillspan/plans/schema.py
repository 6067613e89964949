"""JSON Schema of query documents, and the tool definition made of it, for language models."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from .ir import COMPARISONS, NODES, TYPE_HINTS, UNITS

_EXPR = {"$ref": "#/$defs/expr"}
#: what a plain field may hold
_PLAIN: dict[tuple[str, str], dict[str, Any]] = {
    ("literal", "value"): {"type": ["string", "number", "boolean", "null"]},
    ("literal", "type_hint"): {"type": "string", "description": f"one of {', '.join(TYPE_HINTS)} or a registered type"},
    ("path", "root"): {"type": "string", "description": "content, meta, or a metadata field"},
    ("path", "segments"): {"type": "array", "items": {"type": "string"}},
    ("ref", "name"): {"type": "string", "description": "a name bound in let"},
    ("call", "name"): {"type": "string"},
    ("compare", "op"): {"enum": list(COMPARISONS)},
}
_NOT_REQUIRED = {("literal", "type_hint"), ("path", "segments"), ("call", "args")}


def _closed(properties: dict[str, Any], required: list[str]) -> dict[str, Any]:
    return {"type": "object", "additionalProperties": False, "properties": properties, "required": required}


def query_schema(functions: Iterable[str] | None = None) -> dict[str, Any]:
    """Draft 2020-12; with ``functions`` a call can only name one of them."""
    defs: dict[str, Any] = {"expr": {"oneOf": [{"$ref": f"#/$defs/{tag}"} for tag in NODES]}}
    for tag, cls in NODES.items():
        props: dict[str, Any] = {"node": {"const": tag}}
        for name, how in cls.CODING.items():
            if how == "one":
                props[name] = _EXPR
            elif how == "many":
                props[name] = {"type": "array", "items": _EXPR} | ({"minItems": 2} if tag in ("and", "or") else {})
            else:
                props[name] = dict(_PLAIN[tag, name])
        if tag == "call" and functions is not None:
            props["name"] = {"type": "string", "enum": sorted(set(functions))}
        defs[tag] = _closed(props, ["node", *(n for n in cls.CODING if (tag, n) not in _NOT_REQUIRED)])
    whole = {"type": ["integer", "null"], "minimum": 0}
    defs["select"] = _closed({"unit": {"enum": list(UNITS)}, "window": whole}, ["unit"])
    defs["binding"] = _closed({"name": {"type": "string"}, "expr": _EXPR}, ["name", "expr"])
    defs["orderKey"] = _closed({"expr": _EXPR, "desc": {"type": "boolean"}}, ["expr"])
    top = _closed(
        {
            "select": {"$ref": "#/$defs/select"},
            "let": {"type": "array", "items": {"$ref": "#/$defs/binding"}},
            "where": _EXPR,
            "order_by": {"type": "array", "items": {"$ref": "#/$defs/orderKey"}},
            "limit": whole,
        },
        ["select"],
    )
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "RetrievalQuery", **top, "$defs": defs}


def tool(functions: Iterable[str], name: str = "retrieval_query", description: str | None = None) -> dict[str, Any]:
    return {"type": "function", "function": {"name": name, "description": description or "Search the collection with a query document.", "parameters": query_schema(functions)}}
