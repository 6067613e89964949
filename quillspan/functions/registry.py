"""Named extensions by kind, in scopes: an engine's own shadow the global ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from ..errors import RegistryError

KINDS = ("function", "splitter", "embedder", "modality", "type", "loader", "normalizer")


@dataclass(frozen=True)
class Signature:
    """Number of arguments; ``returns`` is a Spark type in DDL form."""

    args: tuple[str, ...] = ()
    returns: str = "string"
    variadic: bool = False

    def accepts(self, n: int) -> bool:
        return n >= len(self.args) if self.variadic else n == len(self.args)


@dataclass(frozen=True)
class Extension:
    """``build`` makes a Column from Columns and stays inside Catalyst; ``python`` runs as an Arrow UDF."""

    name: str
    kind: str
    build: Callable[..., Any] | None = None
    python: Callable[..., Any] | None = None
    signature: Signature | None = None
    provides_score: bool = False
    pushdown: bool = False
    value: Any = None
    doc: str = ""


class Registry:
    def __init__(self, parent: Registry | None = None):
        self._parent = parent
        self._own: dict[tuple[str, str], Extension] = {}

    def add(self, ext: Extension, overwrite: bool = False) -> Extension:
        if ext.kind not in KINDS:
            raise RegistryError(f"unknown kind {ext.kind!r}")
        key = ext.kind, ext.name.upper()
        if key in self._own and not overwrite:
            raise RegistryError(f"{ext.kind} {ext.name!r} is registered already")
        self._own[key] = ext
        return ext

    def get(self, kind: str, name: str) -> Extension | None:
        found = self._own.get((kind, name.upper()))
        return found or (self._parent.get(kind, name) if self._parent else None)

    def require(self, kind: str, name: str) -> Extension:
        found = self.get(kind, name)
        if not found:
            raise RegistryError(f"no {kind} named {name!r}; there are {', '.join(self.names(kind)) or 'none'}")
        return found

    def names(self, kind: str) -> list[str]:
        own = {n for k, n in self._own if k == kind}
        return sorted(own | set(self._parent.names(kind) if self._parent else ()))

    def child(self) -> Registry:
        return Registry(self)

    # decorators and direct calls

    def function(self, name: str, signature: Signature | None = None, *, build: Callable | None = None, python: Callable | None = None, provides_score: bool = False, pushdown: bool = False, overwrite: bool = False) -> Any:
        """Register a scalar function; as a decorator it takes the Python implementation."""

        def put(f: Callable | None) -> Callable | None:
            self.add(Extension(name, "function", build, f, signature, provides_score, pushdown), overwrite)
            return f

        return put(python) if build or python or provides_score else put

    def splitter(self, name: str, *, build: Callable | None = None, python: Callable | None = None, overwrite: bool = False) -> Any:
        def put(f: Callable | None) -> Callable | None:
            self.add(Extension(name, "splitter", build, f), overwrite)
            return f

        return put(python) if build or python else put

    def type(self, name: str, handler: Any = None, *, overwrite: bool = False) -> Any:
        """A TypeHandler, a class with ``parse`` (and ``compare``) or a parsing function."""
        from .types import handler_of

        def put(h: Any) -> Any:
            self.add(Extension(name, "type", value=handler_of(name, h)), overwrite)
            return h

        return put if handler is None else put(handler)


GLOBAL = Registry()
