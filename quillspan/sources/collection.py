"""Collections: DataFrames with a known envelope."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..operators import text as text_ops
from ..operators.partition import spread
from ..operators.vectors import CellIndex
from ..plans.analyze import PROFILES, Profile
from ..plans.ir import Node

ENVELOPE = ("unit_id", "doc_id", "ordinal", "seq", "content")


@dataclass(frozen=True)
class Collection:
    """Units to be queried.

    ``units`` has the envelope columns; ``fields`` maps dotted metadata names to its
    other columns, ``open_metadata`` names a VARIANT, MAP or STRUCT column that holds
    the rest, ``vectors`` maps vector names to ARRAY<FLOAT> columns of unit length.
    ``documents`` (doc_id, content and the same metadata columns) serves DOCUMENT results.
    ``seq`` may be of any type that can be ordered.  Where the profile isn't exact, ``cells``
    is a layout of the units that approximate searches read, ``newer`` the units it lacks.
    ``remote(condition, query vector, k)`` gives the units of another system that meet a
    condition it can hold; ``units`` then only says their columns.
    """

    units: DataFrame
    granularity: str = "chunk"
    fields: Mapping[str, str] = field(default_factory=dict)
    open_metadata: str | None = None
    vectors: Mapping[str, str] = field(default_factory=dict)
    documents: DataFrame | None = None
    profile: Profile = PROFILES["local"]
    cells: CellIndex | None = None
    newer: DataFrame | None = None
    remote: Callable[[Node | None, Sequence[float] | None, int | None], DataFrame] | None = None

    def __post_init__(self) -> None:
        missing = [c for c in (*ENVELOPE, *self.fields.values(), *self.vectors.values(), *([self.open_metadata] if self.open_metadata else [])) if c not in self.units.columns]
        if missing:
            raise SchemaError(f"the units lack {', '.join(missing)}")

    def field_columns(self) -> dict[str, tuple[Column, T.DataType]]:
        return {name: (F.col(f"`{col}`"), self.units.schema[col].dataType) for name, col in self.fields.items()}

    def metadata_columns(self) -> list[str]:
        return list(dict.fromkeys([*self.fields.values(), *([self.open_metadata] if self.open_metadata else [])]))

    def with_units(self, units: DataFrame) -> Collection:
        return replace(self, units=units)


def of_table(df: DataFrame, ident: str, content: str | Column, fields: Sequence[str] | Mapping[str, str] = (), vectors: Mapping[str, str] | None = None, granularity: str = "document", doc_id: str | None = None, ordinal: str | None = None, seq: str | None = None, profile: Profile = PROFILES["local"]) -> Collection:
    """A table as a collection: its columns become typed metadata, which scans can prune and push down."""
    names = fields if isinstance(fields, Mapping) else {f: f for f in fields}
    text = F.col(content) if isinstance(content, str) else content
    units = df.select(
        F.col(ident).cast("string").alias("unit_id"), F.col(doc_id or ident).cast("string").alias("doc_id"),
        (F.col(ordinal).cast("int") if ordinal else F.lit(0)).alias("ordinal"), (F.col(seq or ident).cast("bigint")).alias("seq"),
        text.alias("content"), *[F.col(c).alias(f"m_{i}_{n.replace('.', '_')}") for i, (n, c) in enumerate(names.items())],
        *[F.col(c).alias(f"v_{n}") for n, c in (vectors or {}).items()],
    )
    meta = {n: f"m_{i}_{n.replace('.', '_')}" for i, n in enumerate(names)}
    own = granularity == "document"
    docs = units.select("doc_id", "content", *meta.values()) if own else None
    return Collection(units, granularity, meta, None, {n: f"v_{n}" for n in vectors or {}}, docs, profile)


def split_units(docs: Collection, granularity: str, splitter: Callable[[Column], Column] | None = None) -> Collection:
    """Finer units of a document-grained collection; ids are doc#granularity:ordinal."""
    f = splitter or {"sentence": text_ops.sentences, "chunk": text_ops.chunks, "document": text_ops.whole}[granularity]
    rest = [c for c in docs.metadata_columns()]
    rows = spread(docs.units).select("doc_id", F.col("seq").alias("__s"), *rest, F.posexplode(f(F.col("content"))).alias("ordinal", "content"))
    units = rows.select(F.concat_ws("", F.col("doc_id"), F.lit(f"#{granularity}:"), F.col("ordinal").cast("string")).alias("unit_id"), "doc_id", "ordinal", F.struct("__s", "ordinal").alias("seq"), "content", *rest)
    return Collection(units, granularity, docs.fields, docs.open_metadata, {}, docs.units.select("doc_id", "content", *rest), docs.profile)


PAYLOAD = T.StructType([T.StructField(n, t) for n, t in (("modality", T.StringType()), ("text", T.StringType()), ("bytes", T.BinaryType()), ("uri", T.StringType()), ("mime", T.StringType()))])

def upsert(current: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows of both, for each key that of the highest seq (last write wins)."""
    rows = current.unionByName(new)
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.col(seq)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in names])


def jdbc_scan(spark: SparkSession, url: str, table: str, condition: str | None = None, **options: Any) -> DataFrame:
    """A filtered scan of a relational table; the condition runs there.

    With ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` it is read in parallel.
    """
    rows = f"(SELECT * FROM {table}" + (f" WHERE {condition}" if condition else "") + ") filtered"
    return spark.read.format("jdbc").options(url=url, dbtable=rows, **options).load()
