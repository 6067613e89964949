"""Second-stage ordering of a bounded set of recalled rows."""

from __future__ import annotations

from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Reranker(Protocol):
    def score(self, query: str, content: Column) -> Column: ...


def overlap(query: str, content: Column) -> Column:
    """Share of the query's distinct tokens that the text holds."""
    wanted = sorted({t for t in query.lower().split() if t})
    have = F.split(F.lower(F.coalesce(content, F.lit(""))), r"(?U)\s+")
    return F.size(F.array_intersect(F.array(*map(F.lit, wanted)).cast("array<string>"), have)) / F.lit(float(max(1, len(wanted))))


class TokenOverlap:
    def score(self, query: str, content: Column) -> Column:
        return overlap(query, content)


class CrossEncoder:
    """A cross-encoder model, loaded once a worker (optional library)."""

    def __init__(self, model: str):
        self.model = model
        self._loaded: Any = None

    def __getstate__(self) -> dict[str, Any]:
        return {"model": self.model, "_loaded": None}

    def predict(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        if self._loaded is None:
            from sentence_transformers import CrossEncoder as Model

            self._loaded = Model(self.model)
        return np.asarray(self._loaded.predict(pairs), float)

    def score(self, query: str, content: Column) -> Column:
        me = self

        def run(s: pd.Series) -> pd.Series:
            return pd.Series(me.predict([(query, t or "") for t in s]))

        run.__annotations__ = {"s": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, T.DoubleType())(content)


def rerank(df: DataFrame, query: str, reranker: Reranker, content: str = "content", ties: tuple[str, ...] = (), name: str = "__rerank") -> DataFrame:
    """Descending by the reranker's score; equal ones keep their order by ``ties``."""
    return df.withColumn(name, reranker.score(query, F.col(content))).orderBy(F.desc(name), *ties)
