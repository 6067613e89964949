"""Queries in Python: ``select("sentence").where(meta("year") >= 2024).limit(5).build()``."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from .plans.ir import And, Call, Compare, Literal, Node, Not, Or, OrderKey, Path, Query, Ref, Select


def _node(value: Any) -> Node:
    return value.node if isinstance(value, Term) else value if isinstance(value, Node) else Literal(value)


def _comparison(op: str):
    def method(self: Term, other: Any) -> Term:
        return Term(Compare(op, self.node, _node(other)))

    return method


def _function(name: str):
    def method(self: Term, other: Any) -> Term:
        return Term(Call(name, (self.node, _node(other))))

    return method


def _joined(kind: type[And] | type[Or]):
    def method(self: Term, other: Any) -> Term:
        left = self.node.operands if isinstance(self.node, kind) else (self.node,)
        return Term(kind((*left, _node(other))))

    return method


class Term:
    """An expression with operators; comparing makes expressions, so terms can't be hashed."""

    __hash__ = None  # type: ignore[assignment]

    def __init__(self, node: Node):
        self.node = node

    __eq__, __ne__ = _comparison("=="), _comparison("!=")  # type: ignore[assignment]
    __lt__, __le__, __gt__, __ge__ = _comparison("<"), _comparison("<="), _comparison(">"), _comparison(">=")
    __and__, __or__ = _joined(And), _joined(Or)
    contains, matches, like = _function("CONTAINS"), _function("MATCH"), _function("LIKE")

    def __invert__(self) -> Term:
        return Term(Not(self.node))

    def __bool__(self) -> bool:
        raise TypeError("use &, | and ~ to combine conditions")


def field(dotted: str) -> Term:
    root, *rest = dotted.split(".")
    return Term(Path(root, tuple(rest)))


def meta(dotted: str) -> Term:
    return Term(Path("meta", tuple(dotted.split("."))))


def ref(name: str) -> Term:
    return Term(Ref(name))


def fn(name: str, *args: Any) -> Term:
    return Term(Call(name, tuple(map(_node, args))))


def similarity(target: str | Term, text: str) -> Term:
    return fn("SIMILARITY", field(target) if isinstance(target, str) else target, text)


def contains(target: Any, text: Any) -> Term:
    return fn("CONTAINS", target, text)


def length(target: Any) -> Term:
    return fn("LENGTH", target)


content = Term(Path("content"))


class Builder:
    """Immutable; every step gives a new one."""

    def __init__(self, query: Query):
        self._query = query

    def let(self, name: str, value: Any) -> Builder:
        return Builder(replace(self._query, let=(*self._query.let, (name, _node(value)))))

    def where(self, *conditions: Any) -> Builder:
        """Further conditions; all must hold."""
        old = self._query.where
        parts = (*(old.operands if isinstance(old, And) else (old,) if old else ()), *map(_node, conditions))
        return Builder(replace(self._query, where=parts[0] if len(parts) == 1 else And(parts)))

    def order_by(self, key: Any, desc: bool = False) -> Builder:
        if isinstance(key, str):
            names = {n for n, _ in self._query.let}
            key = ref(key) if key in names else field(key)
        return Builder(replace(self._query, order_by=(*self._query.order_by, OrderKey(_node(key), desc))))

    def limit(self, n: int) -> Builder:
        return Builder(replace(self._query, limit=n))

    def build(self) -> Query:
        return self._query


def select(unit: str, window: int | None = None) -> Builder:
    return Builder(Query(Select(unit.lower(), window)))
