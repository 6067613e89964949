"""The most similar vectors of every vector, by collision counting.

Vectors are projected on many random directions.  Each end of a direction is one
sorted array that holds the vectors lying far out there, by their projection; so the
arrays are sparse.  A query opens windows centred on its own projection in the arrays
in which it lies farthest out, counts for the vectors inside in how many windows they
are, and verifies with the exact cosine those that reach the collision threshold.  The
windows start narrow and widen (virtual rehashing, counting only what comes in) for the
queries that haven't found k neighbours within the radius yet, up to the radius of
``min_cos``.  Only windows are touched: at 20,000 vectors about a thousand increments a
query instead of 20,000 products, and the directions grow with the vectors.

Cells spread the arrays over tasks: anchors are a sample of the collection, one for
``CELL`` rows; a vector stands in the arrays of its nearest anchor's cell and is
searched for there and in the cells of nearly as near anchors.  A cell expected to hold
more than ``BLOCK`` vectors is cut into blocks by hash, each searched by each part of
the cell's queries, which loses nothing, so a task is bounded however dense a place is.
``exact=True`` compares every query with every vector, block by block.  Exact copies are
one vector until the end.

Rows of one unit: the highest seq counts, whatever its vector.  Null, zero, non-finite
and wrongly sized vectors are unusable; ties go to the smaller id; a collection with
less than k + 1 usable vectors gives what there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.threads import one_thread

#: windows a query opens, collisions that make a candidate, half a window's width in units of the radius
WINDOWS, THRESHOLD, WIDTH = 7, 2, 1.2
#: fewest and most directions; between them one for so many vectors
FEWEST, MOST, PER_DIRECTION = 64, 4096, 16
#: vectors a cell aims at, and most in a task's arrays (denser cells are cut, nothing is left out)
CELL, BLOCK = 4096, 32_768
#: anchors in the driver and every task at most; a larger collection has larger cells, cut into blocks
MOST_ANCHORS = 65_536
#: cells a vector is searched in at most, and by how much less similar their anchors may be
PROBES, SLACK = 8, 0.08
#: sampled vectors an anchor that the sizes of cells are estimated from
SIZE_SAMPLE = 4
#: tasks of the search at most
MOST_TASKS = 50_000
#: anchors that a vector is compared with at once; more are taken block by block, all of them
FLAT = 4096
#: queries, and cosines of the exact way, that a task works on at once
QUERIES, PRODUCTS = 256, 1 << 21
SEED = 20_240_601


def usable(units: DataFrame, dim: int) -> DataFrame:
    """(unit_id, vid, q) of the current versions: q is the direction in 16-bit steps, vid its hash."""

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(2)
            size = np.asarray(vec.value_lengths().fill_null(-1))
            ok = np.flatnonzero(size == dim)
            flat = vec.take(pa.array(ok)).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            most = np.abs(x).max(1) if len(x) else np.zeros(0)
            good = np.isfinite(most) & (most > 0)
            q = np.rint(x[good] / most[good, None] * 32767).astype("<i2")
            out = np.full(b.num_rows, None, object)
            raw, step = q.tobytes(), 2 * dim
            out[ok[good]] = [raw[i : i + step] for i in range(0, len(raw), step)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["unit_id", "seq", "q"])

    rows = units.where(F.col("unit_id").isNotNull()).select("unit_id", "seq", F.col("vector").cast("array<double>").alias("vector") if "double" in dict(units.dtypes)["vector"] else "vector")
    quantised = rows.mapInArrow(quantise, "unit_id string, seq bigint, q binary")
    current = quantised.groupBy("unit_id").agg(F.max(F.struct("seq", "q")).alias("m"))
    return current.select("unit_id", F.col("m.q").alias("q")).where(F.col("q").isNotNull()).select("unit_id", F.xxhash64("q").alias("vid"), "q")


def directions(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors (float32) from their 16-bit form."""
    x = np.frombuffer(b"".join(raw), "<i2").reshape(-1, dim).astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64)).astype(np.float32)[:, None]


def draw_anchors(units: DataFrame, dim: int, cell: int = CELL) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, blocks of each cell): one sampled vector (of any version, lowest hash first) for ``cell`` rows."""
    rows = units.count()
    many = min(MOST_ANCHORS, max(1, rows // cell))
    fit = units.where((F.size("vector") == dim) & F.exists("vector", lambda x: x != 0))
    drawn = fit.select("vector").orderBy(F.xxhash64("unit_id", "seq"), "unit_id").limit(many * (1 + SIZE_SAMPLE)).toArrow().column("vector").combine_chunks()
    a = drawn.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    a = a[np.isfinite(a).all(1)]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    anchors = np.unique(a[:many], axis=0).astype(np.float32)
    if not len(anchors):
        return anchors, np.zeros(0, np.int64)
    rest = np.unique(a[many:], axis=0).astype(np.float32)
    share = np.bincount(Router(anchors).nearest(rest, 1)[0][:, 0], minlength=len(anchors)) / max(1, len(a) - many)
    return anchors, np.maximum(1, np.ceil(share * rows / BLOCK)).astype(np.int64)


class Router:
    """The nearest anchors of vectors, among all anchors at every size; blocks of them bound the memory."""

    def __init__(self, anchors: np.ndarray):
        self.anchors = anchors

    def nearest(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells, cosines), most similar first; -1 where there are fewer."""
        cells, cos = np.full((len(x), probes), -1), np.full((len(x), probes), -9.0, np.float32)
        for s in range(0, len(self.anchors), FLAT):
            block = self.anchors[s : s + FLAT]
            c, v = _top(x @ block.T, np.arange(s, s + len(block)), probes)
            if s:
                c, v = np.concatenate([cells, c], 1), np.concatenate([cos, v], 1)
                o = np.argsort(-v, 1, kind="stable")[:, :probes]
                c, v = np.take_along_axis(c, o, 1), np.take_along_axis(v, o, 1)
            cells, cos = c, v
        return cells, cos


def _top(s: np.ndarray, names: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    k = min(probes, s.shape[1])
    at = np.argpartition(-s, k - 1, 1)[:, :k] if k < s.shape[1] else np.broadcast_to(np.arange(k), (len(s), k))
    val = np.take_along_axis(s, at, 1)
    o = np.argsort(-val, 1, kind="stable")
    cells, val = names[np.take_along_axis(at, o, 1)], np.take_along_axis(val, o, 1)
    if k < probes:
        cells = np.pad(cells, ((0, 0), (0, probes - k)), constant_values=-1)
        val = np.pad(val, ((0, 0), (0, probes - k)), constant_values=-9)
    return cells, val


def _arrays(x: np.ndarray, direction: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """The sorted arrays of all ends, one behind the other: (end * STRIDE + projection, row)."""
    keys, rows = [], []
    for s in range(0, len(x), 2048):
        p = x[s : s + 2048] @ direction
        for sign in (1, -1):
            a, j = np.nonzero(sign * p > cut)
            keys.append((2 * j + (sign < 0)) * STRIDE + sign * p[a, j])
            rows.append(s + a)
    key, row = np.concatenate(keys), np.concatenate(rows)
    o = np.argsort(key, kind="stable")
    return key[o], row[o].astype(np.int32)


#: more than twice any projection of a unit vector
STRIDE = 1024.0


def _collisions(low: np.ndarray, high: np.ndarray, row: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """owner * size + row of every vector in the windows low..high of the arrays."""
    n = np.maximum(high - low, 0)
    inside = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
    return np.repeat(owner * size, n) + row[inside]


def _reaching(collisions: np.ndarray) -> np.ndarray:
    """Those that come THRESHOLD times or more."""
    c = np.sort(collisions)
    c = c[: len(c) - THRESHOLD + 1][c[: len(c) - THRESHOLD + 1] == c[THRESHOLD - 1 :]]
    return c[np.concatenate((c[:1] >= 0, c[1:] != c[:-1]))]


def search_cell(x: np.ndarray, vid: np.ndarray, home: np.ndarray, k: int, min_cos: float, query: np.ndarray | None = None, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query vid, found vid, cosine): at most k for each query, of the vectors at home here."""
    base = np.flatnonzero(home)
    asked = np.arange(len(x)) if query is None else np.flatnonzero(query)
    if not len(base) or not len(asked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    rows, size = x[base], len(base)
    step = max(1, QUERIES if not exact else PRODUCTS // size)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def verify(q: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cos = np.einsum("ij,ij->i", x[q[a]], rows[b])
        near = (cos >= min_cos) & (vid[q[a]] != vid[base[b]])
        a, b, cos = a[near], b[near], cos[near]
        o = np.lexsort((vid[base[b]], -cos, a))
        return a[o], b[o], cos[o]

    def keep(q: np.ndarray, a: np.ndarray, b: np.ndarray, cos: np.ndarray, done: np.ndarray) -> None:
        rank = np.arange(len(a)) - np.searchsorted(a, np.arange(len(q)))[a]
        use = (rank < k) & done[a]
        parts.append((vid[q[a[use]]], vid[base[b[use]]], cos[use]))

    if exact:
        for s in range(0, len(asked), step):
            q = asked[s : s + step]
            a, b = np.nonzero(x[q] @ rows.T >= min_cos - 1e-5)
            keep(q, *verify(q, a, b), np.ones(len(q), bool))
        return tuple(np.concatenate(p) for p in zip(*parts))  # type: ignore[return-value]
    count = int(min(MOST, max(FEWEST, 1 << (size // PER_DIRECTION).bit_length())))
    direction = np.random.default_rng(SEED).standard_normal((x.shape[1], count)).astype(np.float32)
    # distances stay; seen from the middle of the cell fewer lie far out together (of few vectors there is hardly a middle)
    middle = rows.sum(0) / (size + 100)
    last = sqrt(max(0.0, 2 - 2 * min_cos))
    # how far out a query's least window lies in the mean, and where a vector at distance ``last`` from it does
    spread = max(1e-6, float(np.sqrt(np.square(rows - middle).sum(1).mean())))
    out = NormalDist().inv_cdf(1 - WINDOWS / count / 2) * spread
    key, row = _arrays(rows - middle, direction, out * (1 - last * last / (2 * spread * spread)) - 0.1 * last)
    for s in range(0, len(asked), step):
        q = asked[s : s + step]
        p = (x[q] - middle) @ direction
        most = np.argpartition(-np.abs(p), WINDOWS - 1, 1)[:, :WINDOWS]
        p = np.take_along_axis(p, most, 1)
        end, centre = (2 * most + (p < 0)) * STRIDE, np.abs(p)
        active = np.arange(len(q))
        seen = low = high = None
        for radius in (last / 2, last):
            half = WIDTH * radius
            wide = [np.searchsorted(key, (end + centre - half)[active]), np.searchsorted(key, (end + centre + half)[active], "right")]
            owner = np.repeat(np.arange(len(active)), WINDOWS)
            if seen is None:
                seen = _collisions(wide[0].ravel(), wide[1].ravel(), row, owner, size)
            else:  # only what the wider windows add on both sides
                again = np.full(len(q), -1)
                again[active] = np.arange(len(active))
                of = again[seen // size]
                seen = (of * size + seen % size)[of >= 0]
                ring = np.concatenate((wide[0], high[active]), 1), np.concatenate((low[active], wide[1]), 1)
                seen = np.concatenate((seen, _collisions(ring[0].ravel(), ring[1].ravel(), row, np.repeat(np.arange(len(active)), 2 * WINDOWS), size)))
            low, high = wide
            at = _reaching(seen)
            a, b, cos = verify(q[active], at // size, at % size)
            within = np.bincount(a[cos >= 1 - radius * radius / 2], minlength=len(active))
            done = (within >= k) | (radius == last)
            keep(q[active], a, b, cos, done)
            active = active[~done]
            if not len(active):
                break
    return tuple(np.concatenate(p) for p in zip(*parts))  # type: ignore[return-value]


def similar_classes(vectors: DataFrame, anchors: np.ndarray, blocks: np.ndarray, dim: int, k: int, min_cos: float, exact: bool = False) -> DataFrame:
    """(a, b, cos): for each distinct vector a at most k others of cosine at least min_cos."""
    shared = vectors.sparkSession.sparkContext.broadcast((anchors, blocks, np.concatenate(([0], np.cumsum(blocks * blocks)))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        near, cut, first = shared.value
        router = Router(near)
        seen: set[int] = set()  # copies within a partition leave before the shuffle
        size = max(64, min(8192, (1 << 23) // max(1, min(FLAT, len(near)))))
        for whole in batches:
            for s in range(0, whole.num_rows, size):
                b = whole.slice(s, size)
                fresh = []
                for i, v in enumerate(b.column(0).to_pylist()):
                    if v not in seen:
                        seen.add(v)
                        fresh.append(i)
                if not fresh:
                    continue
                b = b.take(pa.array(fresh))
                if exact:
                    row = np.arange(b.num_rows)
                    col = cell = np.zeros(b.num_rows, np.int64)
                else:
                    cells, cos = router.nearest(directions(b.column(1).to_pylist(), dim), PROBES)
                    row, col = np.nonzero((cells >= 0) & (cos >= cos[:, :1] - SLACK))
                    cell = cells[row, col]
                n = cut[cell]
                mine = (b.column(0).to_numpy().view(np.uint64)[row] >> np.uint64(7)) % n.astype(np.uint64)
                mine = mine.astype(np.int64)
                home = col == 0
                # (row, part, at home, searched for): in a cell that isn't cut one row is both
                one = n == 1
                out = [(row[one], first[cell[one]], home[one], np.ones(int(one.sum()), bool))]
                for t in np.flatnonzero(~one):
                    c, m = cell[t], int(n[t])
                    parts = first[c] + np.arange(m) * m + mine[t]  # all blocks, its part of the queries
                    out.append((np.full(m, row[t]), parts, np.zeros(m, bool), np.ones(m, bool)))
                    if home[t]:
                        out.append((np.full(m, row[t]), first[c] + mine[t] * m + np.arange(m), np.ones(m, bool), np.zeros(m, bool)))
                r, part, is_home, is_query = (np.concatenate(x) for x in zip(*out))
                at = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int64()), pa.array(is_home), pa.array(is_query), b.column(0).take(at), b.column(1).take(at)], names=["part", "home", "query", "vid", "q"]
                )

    def search(t: pa.Table) -> pa.Table:
        one_thread()
        # the same vector may come from several partitions, and in a cut cell once in each role
        vid, where = np.unique(t.column("vid").to_numpy(), return_inverse=True)
        home, query = (np.bincount(where, t.column(c).to_numpy(zero_copy_only=False)) > 0 for c in ("home", "query"))
        first = np.zeros(len(vid), np.int64)
        first[where] = np.arange(len(where))
        x = directions(t.column("q").take(pa.array(first)).to_pylist(), dim)
        a, b, cos = search_cell(x, vid, home, k, min_cos, query, exact)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cos": pa.array(np.rint(cos * 1e6), pa.int32())})

    placed = vectors.select("vid", "q").mapInArrow(route, "part bigint, home boolean, query boolean, vid bigint, q binary")
    # a task for about one part, so that none grows with the collection
    session = vectors.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism, min(MOST_TASKS, int((blocks * blocks).sum())))
    found = placed.repartition(tasks, "part").groupBy("part").applyInArrow(search, "a bigint, b bigint, cos int")
    both = found.select("a", "b", "cos", F.explode(F.array(F.lit(True), F.lit(False))).alias("as_is"))
    both = both.select(F.when(F.col("as_is"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("as_is"), F.col("b")).otherwise(F.col("a")).alias("b"), "cos")
    by = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    return both.withColumn("r", F.dense_rank().over(by)).where(F.col("r") <= k).select("a", "b", "cos").distinct()


def most_similar(units: DataFrame, k: int = 5, min_cos: float = 0.85, dim: int = 64, cell: int = CELL, exact: bool = False) -> DataFrame:
    """(unit_a, unit_b, cos): pairs of current units, one among the other's k most similar.

    ``exact`` compares all with all, in blocks (quadratic; for measuring, and for collections it suits).

    Copies of a vector come first in each other's list: every copy is paired with
    the first k others by id, so a vector with n copies gives at most k * n pairs.
    """
    anchors, blocks = draw_anchors(units, dim, cell)
    if exact:
        blocks = np.array([max(1, -(-units.count() // BLOCK))])
    vectors = usable(units, dim)
    if not len(anchors):
        return vectors.select(F.col("unit_id").alias("unit_a"), F.col("unit_id").alias("unit_b"), F.lit(1.0).alias("cos")).where("false")
    top = similar_classes(vectors, anchors, blocks, dim, k, min_cos, exact)
    by_id = Window.partitionBy("vid").orderBy("unit_id")
    names = vectors.select("vid", "unit_id")
    first = names.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    classes = first.groupBy("vid").agg(F.array_sort(F.collect_list("unit_id")).alias("ids"))
    # neighbours fill the places that the copies of a leave, class by class
    near = top.join(classes.select(F.col("vid").alias("b"), F.col("ids").alias("ids_b")), "b")
    near = near.join(classes.select(F.col("vid").alias("a"), F.col("ids").alias("ids_a")), "a")
    before = Window.partitionBy("a").orderBy(F.desc("cos"), "b").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(k + 1) - F.size("ids_a") - F.coalesce(F.sum(F.size("ids_b")).over(before), F.lit(0))
    near = near.withColumn("left", left.cast("int")).where(F.col("left") > 0)
    near = near.select(F.explode("ids_a").alias("u"), F.slice("ids_b", F.lit(1), F.col("left")).alias("ids_b"), "cos").select("u", F.explode("ids_b").alias("v"), "cos")
    several = classes.where(F.size("ids") > 1)
    own = names.join(several, "vid").select(F.col("unit_id").alias("u"), F.slice(F.array_remove("ids", F.col("unit_id")), 1, k).alias("ids"))
    own = own.select("u", F.explode("ids").alias("v"), F.lit(1_000_000).alias("cos"))
    pairs = near.unionByName(own).select(F.least("u", "v").alias("unit_a"), F.greatest("u", "v").alias("unit_b"), "cos")
    return pairs.groupBy("unit_a", "unit_b").agg((F.max("cos") / 1e6).alias("cos"))
