"""The query as immutable nodes; string, builder and JSON front ends all end here.

Every node class lists its fields once, with how each is coded; the JSON codec, the
tree walk and the JSON Schema are derived from that list.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace
from typing import Any, ClassVar

from ..errors import SchemaError

COMPARISONS = ("==", "!=", "<", ">", "<=", ">=")
UNITS = ("document", "chunk", "sentence")
TYPE_HINTS = ("date", "timestamp", "text", "number", "bool")


class Node:
    """Base of expression nodes.  CODING: field -> "plain", "one" (a node) or "many" (a tuple of nodes)."""

    TAG: ClassVar[str]
    CODING: ClassVar[dict[str, str]]
    OPTIONAL: ClassVar[tuple[str, ...]] = ()

    def children(self) -> Iterator[Node]:
        for name, how in self.CODING.items():
            if how == "one":
                yield getattr(self, name)
            elif how == "many":
                yield from getattr(self, name)

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()

    def map(self, f: Callable[[Node], Node]) -> Node:
        """A copy with f applied to the direct children."""
        new = {}
        for name, how in self.CODING.items():
            if how == "one":
                new[name] = f(getattr(self, name))
            elif how == "many":
                new[name] = tuple(f(c) for c in getattr(self, name))
        return replace(self, **new) if new else self  # type: ignore[type-var]

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"node": self.TAG}
        for name, how in self.CODING.items():
            v = getattr(self, name)
            if v is None and name in self.OPTIONAL:
                continue
            out[name] = v.to_dict() if how == "one" else [c.to_dict() for c in v] if how == "many" else list(v) if isinstance(v, tuple) else v
        return out


@dataclass(frozen=True)
class Literal(Node):
    value: str | int | float | bool | None
    type_hint: str | None = None
    TAG = "literal"
    CODING = {"value": "plain", "type_hint": "plain"}
    OPTIONAL = ("type_hint",)

    def __post_init__(self) -> None:
        if not isinstance(self.value, (str, int, float, bool, type(None))):
            raise SchemaError(f"a literal can't hold {self.value!r}")


@dataclass(frozen=True)
class Path(Node):
    root: str
    segments: tuple[str, ...] = ()
    TAG = "path"
    CODING = {"root": "plain", "segments": "plain"}

    def __post_init__(self) -> None:
        if not self.root:
            raise SchemaError("a path needs a root")
        object.__setattr__(self, "segments", tuple(self.segments))

    @property
    def dotted(self) -> str:
        return ".".join((self.root, *self.segments))

    @property
    def field(self) -> str:
        """The metadata key, without the optional ``meta`` root."""
        return ".".join(self.segments if self.root == "meta" and self.segments else (self.root, *self.segments))

    @property
    def is_content(self) -> bool:
        return self.root == "content"


@dataclass(frozen=True)
class Ref(Node):
    name: str
    TAG = "ref"
    CODING = {"name": "plain"}


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...] = ()
    TAG = "call"
    CODING = {"name": "plain", "args": "many"}

    def __post_init__(self) -> None:
        object.__setattr__(self, "args", tuple(self.args))

    @property
    def key(self) -> str:
        """Equal for calls that mean the same, whatever the case of the name."""
        return json.dumps(replace(self, name=self.name.upper()).to_dict(), sort_keys=True, ensure_ascii=False)


@dataclass(frozen=True)
class Compare(Node):
    op: str
    left: Node
    right: Node
    TAG = "compare"
    CODING = {"op": "plain", "left": "one", "right": "one"}

    def __post_init__(self) -> None:
        if self.op not in COMPARISONS:
            raise SchemaError(f"unknown comparison {self.op!r}")


@dataclass(frozen=True)
class And(Node):
    operands: tuple[Node, ...]
    TAG = "and"
    CODING = {"operands": "many"}

    def __post_init__(self) -> None:
        _several(self)


@dataclass(frozen=True)
class Or(Node):
    operands: tuple[Node, ...]
    TAG = "or"
    CODING = {"operands": "many"}

    def __post_init__(self) -> None:
        _several(self)


@dataclass(frozen=True)
class Not(Node):
    operand: Node
    TAG = "not"
    CODING = {"operand": "one"}


def _several(n: And | Or) -> None:
    object.__setattr__(n, "operands", tuple(n.operands))
    if not n.operands:
        raise SchemaError(f"{n.TAG} needs operands")


NODES: dict[str, type[Node]] = {c.TAG: c for c in (Literal, Path, Ref, Call, Compare, And, Or, Not)}


def node_from(d: Any) -> Node:
    if not isinstance(d, dict) or d.get("node") not in NODES:
        raise SchemaError(f"not an expression: {d!r}")
    cls = NODES[d["node"]]
    values = {}
    for f in fields(cls):  # type: ignore[arg-type]
        if f.name not in d:
            continue
        how = cls.CODING[f.name]
        v = d[f.name]
        if how == "many" and not isinstance(v, (list, tuple)):
            raise SchemaError(f"{f.name} of {cls.TAG} must be a list")
        values[f.name] = node_from(v) if how == "one" else tuple(map(node_from, v)) if how == "many" else v
    unknown = set(d) - {"node", *cls.CODING}
    if unknown:
        raise SchemaError(f"unknown fields of {cls.TAG}: {sorted(unknown)}")
    try:
        return cls(**values)
    except TypeError as e:
        raise SchemaError(f"incomplete {cls.TAG}: {d!r}") from e


@dataclass(frozen=True)
class Select:
    unit: str
    window: int | None = None

    def __post_init__(self) -> None:
        if self.unit not in UNITS:
            raise SchemaError(f"unknown unit {self.unit!r}; there are {', '.join(UNITS)}")
        if self.window is not None and (isinstance(self.window, bool) or not isinstance(self.window, int) or self.window < 0):
            raise SchemaError("a span's window must be an integer of at least 0")


@dataclass(frozen=True)
class OrderKey:
    expr: Node
    desc: bool = False


@dataclass(frozen=True)
class Query:
    select: Select
    let: tuple[tuple[str, Node], ...] = ()
    where: Node | None = None
    order_by: tuple[OrderKey, ...] = ()
    limit: int | None = None

    def __post_init__(self) -> None:
        if self.limit is not None and (isinstance(self.limit, bool) or not isinstance(self.limit, int) or self.limit < 0):
            raise SchemaError("LIMIT must be an integer of at least 0")
        names = [n for n, _ in self.let]
        if len(set(names)) < len(names):
            raise SchemaError(f"a LET name is bound twice: {sorted({n for n in names if names.count(n) > 1})}")

    def to_dict(self) -> dict[str, Any]:
        select: dict[str, Any] = {"unit": self.select.unit}
        if self.select.window is not None:
            select["window"] = self.select.window
        parts = {
            "let": [{"name": n, "expr": e.to_dict()} for n, e in self.let],
            "where": self.where and self.where.to_dict(),
            "order_by": [{"expr": k.expr.to_dict(), "desc": k.desc} for k in self.order_by],
        }
        return {"select": select} | {k: v for k, v in parts.items() if v} | ({} if self.limit is None else {"limit": self.limit})

    @classmethod
    def from_dict(cls, d: Any) -> Query:
        if not isinstance(d, dict) or not isinstance(d.get("select"), dict):
            raise SchemaError("a query document needs a select clause")
        unknown = set(d) - {"select", "let", "where", "order_by", "limit"}
        if unknown:
            raise SchemaError(f"unknown clauses: {sorted(unknown)}")
        try:
            return cls(
                Select(d["select"]["unit"], d["select"].get("window")),
                tuple((b["name"], node_from(b["expr"])) for b in d.get("let") or ()),
                None if d.get("where") is None else node_from(d["where"]),
                tuple(OrderKey(node_from(k["expr"]), bool(k.get("desc", False))) for k in d.get("order_by") or ()),
                d.get("limit"),
            )
        except (KeyError, TypeError) as e:
            raise SchemaError(f"malformed query document: {e}") from e

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Query:
        try:
            return cls.from_dict(json.loads(text))
        except json.JSONDecodeError as e:
            raise SchemaError(f"not JSON: {e}") from e
