"""Errors of the engine.  Whatever can be known from the query alone is raised before anything runs."""

from __future__ import annotations


class QueryError(Exception):
    """Base of all of them."""


class ParseError(QueryError):
    def __init__(self, message: str, line: int = 0, column: int = 0, context: str = ""):
        self.line, self.column, self.context = line, column, context
        where = f" at line {line}, column {column}" if line else ""
        super().__init__(f"{message}{where}" + (f"\n{context}\n{' ' * (column - 1)}^" if context else ""))


class SchemaError(QueryError):
    """A malformed query document or collection."""


class RegistryError(QueryError):
    """A name registered twice, or not at all."""


class TypeMismatch(QueryError):
    """Operands that no rule can compare."""


class PlanError(QueryError):
    """A query that is well formed but can't be planned."""


class ExecutionError(QueryError):
    pass


class EmbeddingError(QueryError):
    pass
