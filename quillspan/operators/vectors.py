"""Vector recall: exact top-k inside Catalyst, many queries at once, and an approximate cell layout."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExecutionError
from .threads import one_thread

#: bytes of query vectors that go to every task at once
QUERY_BYTES = 32_000_000
#: score of a row without the named vector
MISSING = -2.0


def dot(v: Column, query: Sequence[float]) -> Column:
    """Inner product with a constant, in double, as whole-stage code."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)


def arrow_dot(v: Column, query: Sequence[float]) -> Column:
    """The same as one matrix product an Arrow batch, without copying the vectors; null for null.

    Higher-order functions take about a microsecond an element, so this is the usual way.
    """
    q = np.asarray(query, np.float64)

    def run(a: pa.Array) -> pa.Array:
        there = a.is_valid()
        vec = a.drop_null()
        size = np.asarray(vec.value_lengths())
        if len(size) and (size != len(q)).any():
            raise ExecutionError(f"query vector of {len(q)} numbers, stored one of {int(size[size != len(q)][0])}")
        out = np.full(len(a), np.nan)
        out[np.asarray(there)] = vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(q)).astype(np.float64) @ q
        return pa.array(out, pa.float64(), mask=~np.asarray(there))

    run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.DoubleType())(v)


def score(v: Column, query: Sequence[float], missing: bool = False) -> Column:
    """Cosine of unit vectors; a wrong dimension is an error, a missing named vector scores MISSING."""
    value = arrow_dot(v, query)
    return F.coalesce(value, F.lit(MISSING)) if missing else value


def top_k(df: DataFrame, vector: str, query: Sequence[float], k: int | None, tie: Sequence[str] = (), name: str = "score") -> DataFrame:
    """Exact: filters of df come first, then score, then TakeOrdered."""
    out = df.withColumn(name, score(F.col(vector), query)).orderBy(F.desc(name), *tie)
    return out if k is None else out.limit(k)


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column that has no nulls, without a copy a row."""
    size = np.asarray(vectors.value_lengths())
    if len(size) and (size != dim).any():
        raise ExecutionError(f"query vectors of {dim} numbers, stored ones of {int(size[size != dim][0])}")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def batch_top_k(df: DataFrame, ident: str, vector: str, queries: DataFrame, k: int, block: int = 1024, min_score: float | None = None) -> DataFrame:
    """(query_id, *ident*, score, rank): exact top-k of every query vector against all rows, in blocks.

    ``queries`` is a stated query set (query_id, vector) of any size.  It is taken in parts
    of QUERY_BYTES, one after the other: each part is broadcast, each task keeps k rows a
    query, and only those are shuffled.
    """
    kind = dict(df.dtypes)[ident]
    asked = queries.where(F.col("vector").isNotNull()).select(F.col("query_id").cast("bigint").alias("query_id"), "vector")
    count, dim = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not count:
        return df.limit(0).select(F.lit(None).cast("bigint").alias("query_id"), F.col(ident), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank"))
    parts = -(-count * dim * 8 // QUERY_BYTES)
    found = None
    for p in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p) if parts > 1 else asked
        some = _scan_for(df, ident, vector, mine, dim, k, block, min_score, kind)
        found = some if found is None else found.unionByName(some)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), ident)
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def best_of_block(sim: np.ndarray, k: int, min_score: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k best of each query, with the ties at the edge, so that the final order decides."""
    n = min(k, sim.shape[1])
    edge = np.partition(sim, sim.shape[1] - n, 1)[:, sim.shape[1] - n]
    if min_score is not None:
        edge = np.maximum(edge, min_score)
    return np.nonzero(sim >= edge[:, None])


def _scan_for(df: DataFrame, ident: str, vector: str, queries: DataFrame, dim: int, k: int, block: int, min_score: float | None, kind: str) -> DataFrame:
    table = queries.toArrow()
    shared = df.sparkSession.sparkContext.broadcast((table.column("query_id").to_numpy(), matrix(table.column("vector").combine_chunks(), dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        names, q = shared.value
        for b in batches:
            there = np.flatnonzero(np.asarray(b.column(1).is_valid()))
            if not len(there):
                continue
            at = pa.array(there)
            m, key = matrix(b.column(1).take(at), dim), b.column(0).take(at)
            for s in range(0, len(q), block):
                sim = q[s : s + block] @ m.T
                x, y = best_of_block(sim, k, min_score)
                yield pa.RecordBatch.from_arrays([pa.array(names[s + x], pa.int64()), key.take(pa.array(y)), pa.array(sim[x, y])], names=["query_id", ident, "score"])

    return df.select(ident, vector).mapInArrow(run, f"query_id bigint, `{ident}` {kind}, score double")


class CellIndex:
    """Layout by cells: rows partitioned by their nearest centre; a query reads the cells nearest to it.

    Centres are fitted by Spark ML's k-means on a bounded sample (``sample`` rows); every
    row is placed.  ``search`` is approximate, ``probes`` trades recall for reading;
    ``batch_search`` reads further until no unread cell can hold a better row, by the
    ``radii`` of the cells (without them it reads all).
    """

    def __init__(self, path: str, centres: np.ndarray, vector: str, radii: np.ndarray | None = None, probes: int = 8):
        self.path, self.centres, self.vector, self.probes = path, centres, vector, probes
        self.radii = np.full(len(centres), np.inf) if radii is None else radii

    @classmethod
    def build(cls, df: DataFrame, vector: str, path: str, cells: int = 64, sample: int = 200_000, seed: int = 7) -> CellIndex:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        n = df.count()
        part = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
        if n > sample:
            part = part.sample(fraction=min(1.0, sample / n), seed=seed)
        model = KMeans(k=min(cells, max(2, n)), seed=seed, maxIter=10).fit(part)
        centres = np.array(model.clusterCenters())
        cls(path, centres, vector)._place(df).write.mode("overwrite").partitionBy("cell").parquet(path)
        radii = np.zeros(len(centres))
        for r in df.sparkSession.read.parquet(path).groupBy("cell").agg(F.max(cls(path, centres, vector)._distance()).alias("far")).collect():
            radii[r.cell] = r.far
        return cls(path, centres, vector, radii)

    def wider(self) -> CellIndex:
        """The same, reading twice as many cells."""
        return CellIndex(self.path, self.centres, self.vector, self.radii, 2 * self.probes)

    def near(self, spark, query: Sequence[float]) -> DataFrame:
        """The rows of the ``probes`` cells nearest to the query; others aren't read."""
        order = np.argsort(((self.centres - np.asarray(query, np.float64)) ** 2).sum(1), kind="stable")
        return spark.read.parquet(self.path).where(F.col("cell").isin([int(x) for x in order[: self.probes]]))

    def to_json(self) -> dict:
        return {"path": self.path, "vector": self.vector, "centres": self.centres.tolist(), "radii": self.radii.tolist(), "probes": self.probes}

    @classmethod
    def from_json(cls, d: dict) -> CellIndex:
        return cls(d["path"], np.array(d["centres"]), d["vector"], np.array(d["radii"]), d["probes"])

    def _place(self, df: DataFrame) -> DataFrame:
        c = self.centres
        half = (c * c).sum(1) / 2

        def run(a: pa.Array) -> pa.Array:
            one_thread()
            return pa.array((matrix(a, c.shape[1]) @ c.T - half).argmax(1).astype("int32"))

        run.__annotations__ = {"a": pa.Array, "return": pa.Array}
        return df.withColumn("cell", F.arrow_udf(run, T.IntegerType())(F.col(self.vector)))

    def _distance(self) -> Column:
        """Of a placed row from the centre of its cell."""
        c = self.centres

        def run(vec: pa.Array, cell: pa.Array) -> pa.Array:
            return pa.array(np.sqrt(((matrix(vec, c.shape[1]) - c[cell.to_numpy()]) ** 2).sum(1)))

        run.__annotations__ = {"vec": pa.Array, "cell": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, T.DoubleType())(F.col(self.vector), F.col("cell"))

    def search(self, spark, query: Sequence[float], k: int, probes: int = 8, condition: Column | None = None, tie: Sequence[str] = ()) -> DataFrame:
        """Partition pruning reads only the probed cells; more are probed while they leave fewer than k."""
        q = np.asarray(query, np.float64)
        order = np.argsort(((self.centres - q) ** 2).sum(1), kind="stable")
        df = spark.read.parquet(self.path)
        while True:
            part = df.where(F.col("cell").isin([int(x) for x in order[:probes]]))
            part = part if condition is None else part.where(condition)
            if probes >= len(order) or part.limit(k).count() >= k:
                return top_k(part, self.vector, list(q), k, tie)
            probes *= 2

    def batch_search(self, spark, ident: str, queries: DataFrame, k: int, probes: int = 8, block: int = 1024) -> DataFrame:
        """(query_id, *ident*, score, rank): the k best of all rows for every query vector, none lost.

        The nearest ``probes`` cells give each query the score to beat.  A row of a cell
        scores at most the centre's product plus the radius times the query's length, so
        the cells that may still hold a better or equal row are searched, and only those.
        """
        rows = queries.select("query_id", "vector").collect()
        ids = np.array([r.query_id for r in rows], np.int64)
        q = np.array([r.vector for r in rows], np.float64).reshape(len(rows), self.centres.shape[1])
        distance = (self.centres * self.centres).sum(1) - 2 * q @ self.centres.T
        nearest = np.argsort(distance, 1, kind="stable")[:, :probes]
        reach = np.zeros(distance.shape, bool)
        np.put_along_axis(reach, nearest, True, 1)
        first = self._found(spark, ident, ids, q, reach, k, block).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        beat = {r.query_id: r.least for r in first.where(F.col("n") >= k).collect()}
        floor = np.array([beat.get(int(i), -np.inf) for i in ids]).reshape(-1, 1)
        bound = q @ self.centres.T + np.linalg.norm(q, axis=1)[:, None] * self.radii
        return self._found(spark, ident, ids, q, bound >= floor - 1e-6, k, block)

    def _found(self, spark, ident: str, ids: np.ndarray, q: np.ndarray, reach: np.ndarray, k: int, block: int) -> DataFrame:
        """The k best rows of each query among the cells it reaches."""
        shared = spark.sparkContext.broadcast((ids, q, reach))
        df = spark.read.parquet(self.path)
        kind, dim = dict(df.dtypes)[ident], q.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            names, vectors, cells = shared.value
            for b in batches:
                of = b.column(2).to_numpy()
                for cell in np.unique(of):
                    at = pa.array(np.flatnonzero(of == cell))
                    m, key = matrix(b.column(1).take(at), dim), b.column(0).take(at)
                    asked = np.flatnonzero(cells[:, cell])
                    for s in range(0, len(asked), block):
                        some = asked[s : s + block]
                        sim = vectors[some] @ m.T
                        x, y = best_of_block(sim, k)
                        yield pa.RecordBatch.from_arrays([pa.array(names[some[x]], pa.int64()), key.take(pa.array(y)), pa.array(sim[x, y])], names=["query_id", ident, "score"])

        read = df.where(F.col("cell").isin([int(x) for x in np.flatnonzero(reach.any(0))]))
        found = read.select(ident, self.vector, "cell").mapInArrow(run, f"query_id bigint, `{ident}` {kind}, score double")
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), ident)
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
