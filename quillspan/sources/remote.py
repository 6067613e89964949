"""Collections that live in another system: its own filter and top-k narrow the rows down, the engine does the rest.

Whatever part of a condition a layout can hold itself (its profile says which) is handed
over in that system's form; all of the condition is checked again here, so a system that
returns too much changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import translate
from ..plans.analyze import PROFILES, Profile
from ..plans.ir import And, Compare, Node, Not
from .collection import Collection

ROWS = "unit_id string, doc_id string, ordinal int, seq bigint, content string, metadata string, vector array<float>"


def literal(value: Any) -> str:
    if value is None or isinstance(value, bool):
        return "NULL" if value is None else str(value).upper()
    return repr(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def inline(condition: str, values: Sequence[Any]) -> str:
    """A condition with its parameters written into it, where a driver takes none."""
    parts = condition.split("%s")
    if len(parts) != len(values) + 1:
        raise ValueError(f"{len(values)} parameters for {len(parts) - 1} places")
    return parts[0] + "".join(literal(v) + p for v, p in zip(values, parts[1:]))


def statement(table: str, where: Node | None, vector: Sequence[float] | None, k: int | None, distance: str) -> str:
    """The rows that meet a condition, the k nearest to a vector if one is given."""
    out = f"SELECT unit_id, doc_id, ordinal, seq, content, CAST(metadata AS VARCHAR) AS metadata, CAST(vector AS VARCHAR) AS vector FROM {table}"
    if where is not None:
        out += f" WHERE {inline(*translate.sql_filter(where))}"
    if vector is not None and k is not None:
        out += f" ORDER BY {distance.format(v='[' + ','.join(repr(float(x)) for x in vector) + ']')}, seq, unit_id LIMIT {int(k)}"
    return out


def superset(where: Node | None) -> Node | None:
    """The part of a condition that SQL's three-valued logic doesn't narrow: without negations, which lose rows that lack a field."""
    if where is None or not any(isinstance(n, Not) or (isinstance(n, Compare) and n.op == "!=") for n in where.walk()):
        return where
    if not isinstance(where, And):
        return None
    kept = [c for c in map(superset, where.operands) if c is not None]
    return None if not kept else kept[0] if len(kept) == 1 else And(tuple(kept))


def _collection(spark: SparkSession, granularity: str, profile: Profile, rows: Callable[[Node | None, Sequence[float] | None, int | None], DataFrame]) -> Collection:
    def typed(where: Node | None, vector: Sequence[float] | None, k: int | None) -> DataFrame:
        return rows(where, vector, k).withColumn("metadata", F.parse_json("metadata"))

    empty = spark.createDataFrame([], ROWS).withColumn("metadata", F.parse_json("metadata"))
    return Collection(empty, granularity, {}, "metadata", {"default": "vector"}, None, profile, remote=typed)


class RelationalSource:
    """A table of a database with vectors, read over JDBC; ``options`` may ask for a parallel scan.

    ``distance`` is the database's expression by which the nearest come first, with {v} for the query vector.
    """

    def __init__(self, spark: SparkSession, url: str, table: str, distance: str = "vector <=> '{v}'", **options: Any):
        self.spark, self.url, self.table, self.distance, self.options = spark, url, table, distance, options

    def query(self, where: Node | None, vector: Sequence[float] | None, k: int | None) -> str:
        safe = superset(where)
        if safe is not where:  # the rest is checked here, so the nearest must be found here too
            vector = k = None
        return statement(self.table, safe, vector, k, self.distance)

    def rows(self, where: Node | None, vector: Sequence[float] | None, k: int | None) -> DataFrame:
        query = f"({self.query(where, vector, k)}) rows"
        df = self.spark.read.format("jdbc").options(url=self.url, dbtable=query, **self.options).load()
        return df.withColumn("vector", F.from_json("vector", "array<float>"))

    def collection(self, granularity: str, vector_names: Sequence[str] = (), profile: Profile = PROFILES["pgvector"]) -> Collection:
        return _collection(self.spark, granularity, profile if profile.name != "local" else PROFILES["pgvector"], self.rows)


class ServiceSource:
    """A vector service: ``fetch(filter, vector, k)`` gives its rows as mappings (of ``ROWS``, metadata a mapping).

    ``form`` makes the service's filter of a condition.  A top-k brings k rows to the
    driver; a scan without one brings all that meet the filter, as such services do.
    """

    def __init__(self, spark: SparkSession, fetch: Callable[[Any, Sequence[float] | None, int | None], Iterable[Mapping[str, Any]]], form: Callable[[Node], Any] = translate.must_filter, profile: Profile = PROFILES["qdrant"]):
        self.spark, self.fetch, self.form, self.profile = spark, fetch, form, profile

    def rows(self, where: Node | None, vector: Sequence[float] | None, k: int | None) -> DataFrame:
        found = self.fetch(None if where is None else self.form(where), vector, k)
        names = [c.split()[0] for c in ROWS.split(", ")]
        return self.spark.createDataFrame([tuple(json.dumps(r[n], default=str) if n == "metadata" else r.get(n) for n in names) for r in found], ROWS)

    def collection(self, granularity: str, vector_names: Sequence[str] = (), profile: Profile | None = None) -> Collection:
        return _collection(self.spark, granularity, self.profile, self.rows)
