"""From an analysed query to one lazy DataFrame: score, filter, order, change granularity, rerank, limit."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.registry import Registry
from ..operators import rerank as rerank_ops
from ..operators import text as text_ops
from ..operators import vectors
from ..sources.collection import Collection
from .analyze import Analyzed
from .compile import Compiler, Scope
from .ir import Query

#: times its limit that an approximate search wants to find before it stops reading cells
OVERFETCH = 3
#: a SPAN of at most so many hits takes them first and broadcasts them
SPAN_JOIN = 10_000


@dataclass
class Settings:
    registry: Registry
    field_types: Mapping[str, str]
    strict: bool = True
    reranker: rerank_ops.Reranker | None = None
    rerank_query: str | None = None
    rerank_factor: int = 5
    insertion_order: bool = True


def check_granularity(query: Query, indexed: str) -> None:
    """Raises for a conversion there is no meaning for."""
    unit, window = query.select.unit, query.select.window
    if unit == "document" and window is not None and indexed != "document":
        raise PlanError("SPAN(DOCUMENT) has no meaning")
    if unit == indexed or unit == "document":
        return
    if indexed not in ("document", "chunk", "sentence"):
        if unit == "chunk":
            return  # the index unit of a custom granularity
        raise PlanError(f"can't select {unit} from units of {indexed}")
    if unit == "chunk" and (indexed == "document" or window is not None):
        raise PlanError(f"can't select {'a span of chunks' if window is not None else 'chunk'} from units of {indexed}")


def build(a: Analyzed, c: Collection, query_vectors: Mapping[str, list[float]], s: Settings) -> DataFrame:
    q = a.query
    check_granularity(q, c.granularity)
    df = _recalled(a, c, query_vectors, s)
    scores: dict[str, Column] = {}
    for i, scorer in enumerate(a.scorers.values()):
        if scorer.vector not in c.vectors and scorer.vector == "default":
            raise PlanError("the collection has no vectors")
        col = F.col(c.vectors[scorer.vector]) if scorer.vector in c.vectors else F.lit(None).cast("array<float>")
        df = df.withColumn(f"__s{i}", vectors.score(col, query_vectors[scorer.key], missing=scorer.vector != "default"))
        if scorer.vector == "default":
            df = df.where(col.isNotNull())
        scores[scorer.key] = F.col(f"__s{i}")
    open_ = (F.col(c.open_metadata), c.units.schema[c.open_metadata].dataType) if c.open_metadata else None
    comp = Compiler(Scope(F.col("content"), c.field_columns(), open_, s.registry, a.bindings, scores, s.field_types, s.strict))
    if q.where is not None:
        df = df.where(comp.where(q.where))
        if approximate(a, c):
            # a filter may leave too few of the nearest cells: more are read while it does
            want = q.limit * OVERFETCH
            while c.cells.probes < len(c.cells.centres) and df.limit(want).count() < want:
                wider = replace(c, cells=c.cells.wider())
                return build(a, wider, query_vectors, s)
    names = []
    for name, e in q.let:
        df = df.withColumn(f"__let_{name}", comp.value(e).col)
        names.append(name)
    keys: list[Column] = []
    for i, k in enumerate(q.order_by):
        for j, (col, desc, nulls_first) in enumerate(comp.order(k.expr, k.desc)):
            df = df.withColumn(f"__o{i}_{j}", col)
            keys.append(_sorted(F.col(f"__o{i}_{j}"), desc, nulls_first))
    if not q.order_by and scores:
        keys.append(next(iter(scores.values())).desc_nulls_last())
    keys += [F.col("seq").asc_nulls_last(), F.col("unit_id").asc_nulls_last()]
    rest = [x for x in df.columns if x.startswith("__")]
    meta = c.metadata_columns()
    df = df.select("unit_id", "doc_id", "ordinal", "seq", "content", *meta, *rest)
    reranks = s.reranker is not None and bool(a.scorers)
    early = None if q.limit is None else q.limit * (s.rerank_factor if reranks else 1)
    df = _granularity(df, c, q, keys, meta, rest, early, s)
    if reranks:
        text = s.rerank_query or next(iter(a.scorers.values())).text
        if early is not None:
            df = df.orderBy(*keys).limit(early)
        df = df.withColumn("__rerank", s.reranker.score(text, F.col("content")))
        keys = [F.desc("__rerank"), *keys]
    if s.insertion_order or q.order_by or scores or q.limit is not None:
        df = df.orderBy(*keys)
    if q.limit is not None:
        df = df.limit(q.limit)
    span = [x for x in ("span_start", "span_end") if x in df.columns]
    out = ["unit_id", "doc_id", "kind", "ordinal", "content", *span]
    fields = [F.col(f"`{col}`").alias(name) for name, col in c.fields.items()]
    metadata = F.col(c.open_metadata) if c.open_metadata else F.struct(*fields) if fields else None
    shown = [F.col(f"__let_{n}").alias(n) for n in names if n not in (*out, "metadata")]
    return df.select(*out, *shown, *([metadata.alias("metadata")] if metadata is not None else []))


def approximate(a: Analyzed, c: Collection) -> bool:
    """Whether the nearest cells are enough: an index, a layout that allows it, and a limit on one similarity's order."""
    return not c.profile.exact and c.cells is not None and _nearest_first(a)


def _nearest_first(a: Analyzed) -> bool:
    q = a.query
    if q.limit is None or len(a.scorers) != 1 or next(iter(a.scorers.values())).vector != "default":
        return False
    if not q.order_by:
        return True
    return q.order_by[0].desc and a.expand(q.order_by[0].expr).key == next(iter(a.scorers))


def _recalled(a: Analyzed, c: Collection, query_vectors: Mapping[str, list[float]], s: Settings) -> DataFrame:
    """The units to score: all, those that another system finds, or those of the cells nearest to the query."""
    if c.remote is not None:
        # its own top-k only where nothing is left to be filtered here
        nearest = _nearest_first(a) and a.residual is None and a.query.select.unit == c.granularity
        vector = query_vectors[next(iter(a.scorers))] if nearest else None
        return c.remote(a.pushed, vector, a.query.limit * (OVERFETCH if not c.profile.exact else 1) * (s.rerank_factor if s.reranker else 1) if nearest else None)
    if not approximate(a, c):
        return c.units
    near = c.cells.near(c.units.sparkSession, query_vectors[next(iter(a.scorers))])
    return near.select(*c.units.columns) if c.newer is None else near.select(*c.units.columns).unionByName(c.newer.select(*c.units.columns))


def _sorted(col: Column, desc: bool, nulls_first: bool) -> Column:
    if desc:
        return col.desc_nulls_first() if nulls_first else col.desc_nulls_last()
    return col.asc_nulls_first() if nulls_first else col.asc_nulls_last()


def _granularity(df: DataFrame, c: Collection, q: Query, keys: list[Column], meta: list[str], rest: list[str], early: int | None, s: Settings) -> DataFrame:
    unit, window, indexed = q.select.unit, q.select.window, c.granularity
    if unit == indexed or (unit == "chunk" and indexed not in ("document", "chunk", "sentence")):
        if window is None:
            return df.withColumn("kind", F.lit(indexed))
        return _span(df, c.units.select("doc_id", "ordinal", "content"), window, keys, early)
    if unit == "document":
        best = df.withColumn("__r", F.row_number().over(Window.partitionBy("doc_id").orderBy(*keys))).where("__r = 1").drop("__r")
        if c.documents is not None:
            docs = c.documents.select(F.col("doc_id"), F.col("content").alias("__text"), F.lit(True).alias("__there"), *[F.col(m).alias(f"__m{i}") for i, m in enumerate(meta)])
            best = best.join(docs, "doc_id", "left")
            best = best.withColumn("content", F.when(F.col("__there"), F.col("__text")).otherwise(F.col("content")))
            for i, m in enumerate(meta):
                best = best.withColumn(m, F.when(F.col("__there"), F.col(f"__m{i}")).otherwise(F.col(m)))
        return best.select(F.col("doc_id").alias("unit_id"), "doc_id", F.lit(0).alias("ordinal"), "seq", "content", *meta, *rest, F.lit("document").alias("kind"))
    if unit == "chunk":  # from sentences: those of a document in rank order
        ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy("doc_id").orderBy(*keys)))
        carried = [F.min_by(x, "__r").alias(x) for x in ("seq", *meta, *rest)]
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "content"))), lambda x: x["content"]), " ")
        out = ranked.groupBy("doc_id").agg(text.alias("content"), *carried)
        return out.select(F.concat("doc_id", F.lit("#chunk")).alias("unit_id"), "doc_id", F.lit(0).alias("ordinal"), "seq", "content", *meta, *rest, F.lit("chunk").alias("kind"))
    # sentences from coarser units; a unit may give none, so a limit comes after the split
    split = s.registry.get("splitter", "SENTENCE")

    def pieces(text: Column) -> Column:
        if split is None:
            return text_ops.sentences(text)
        return split.build(text) if split.build else F.udf(split.python, "array<string>", useArrow=True)(text)

    fine = df.select("doc_id", "ordinal", "seq", *meta, *rest, F.col("unit_id").alias("__unit"), F.posexplode(pieces(F.col("content"))).alias("__i", "content"))
    fine = fine.withColumn("unit_id", F.concat("doc_id", F.lit("#sent:"), F.col("ordinal").cast("string"), F.lit(":"), F.col("__i").cast("string")))
    if window is None:
        return fine.select("unit_id", "doc_id", (F.col("ordinal") + F.col("__i")).alias("ordinal"), F.struct("seq", "__i").alias("seq"), "content", *meta, *rest, F.lit("sentence").alias("kind"))
    # neighbours are the document's sentences, numbered through all its units
    every = c.units.select("doc_id", "ordinal", F.posexplode(pieces(F.col("content"))).alias("__i", "content"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal", "__i")) - 1
    every = every.withColumn("__n", number)
    fine = fine.join(every.select("doc_id", "ordinal", "__i", "__n"), ["doc_id", "ordinal", "__i"])
    fine = fine.select("unit_id", "doc_id", F.col("__n").alias("ordinal"), F.struct("seq", "__i").alias("seq"), "content", *meta, *rest)
    return _span(fine, every.select("doc_id", F.col("__n").alias("ordinal"), "content"), window, keys, early)


def _span(hits: DataFrame, units: DataFrame, window: int, keys: list[Column], early: int | None) -> DataFrame:
    """Each hit with its neighbours' text, by a range join in buckets of ordinals.

    A document's ordinals are cut into buckets, and a hit goes to those that its window
    touches, so a document with any share of the units is joined in small pieces.  Few
    hits (a LIMIT) are taken first and broadcast.  The hits enter the plan once, with all
    their columns, so that nothing they need (scores, embeddings) is computed twice.
    """
    width = max(64, 2 * window + 1)
    few = early is not None and early <= SPAN_JOIN
    if few:
        hits = hits.orderBy(*keys).limit(early)
    buckets = F.sequence(F.floor((F.col("ordinal") - window) / width), F.floor((F.col("ordinal") + window) / width))
    centre = hits.withColumn("__b", F.explode(buckets))
    if few:
        centre = F.broadcast(centre)  # at most 2 * SPAN_JOIN rows
    placed = units.select(F.col("doc_id").alias("__d"), F.col("ordinal").alias("__o"), F.col("content").alias("__t"), F.floor(F.col("ordinal") / width).alias("__u"))
    near = placed.join(centre, (F.col("doc_id") == F.col("__d")) & (F.col("__u") == F.col("__b")) & F.col("__o").between(F.col("ordinal") - window, F.col("ordinal") + window))
    carried = [F.first(c).alias(c) for c in hits.columns if c != "unit_id"]
    out = near.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("__o", "__t"))).alias("__near"), *carried)
    text = F.array_join(F.transform("__near", lambda x: F.coalesce(x["__t"], F.lit(""))), " ")
    out = out.withColumns({"content": text, "span_start": F.element_at("__near", 1)["__o"], "span_end": F.element_at("__near", -1)["__o"], "kind": F.lit("span")})
    return out.withColumn("unit_id", F.concat("doc_id", F.lit("#span:"), F.col("ordinal").cast("string"), F.lit(f"~{window}"))).drop("__near")


def neighbours(hits: DataFrame, units: DataFrame, window: int) -> DataFrame:
    """(doc_id, centre, ordinal, content): the units within ``window`` ordinals of every hit (doc_id, ordinal), itself too.

    The range join of ``_span``, in buckets of ordinals, with a row a neighbour; a hit
    that isn't there gives nothing.
    """
    width = max(64, 2 * window + 1)
    buckets = F.sequence(F.floor((F.col("ordinal") - window) / width), F.floor((F.col("ordinal") + window) / width))
    centre = hits.select(F.col("doc_id").alias("__d"), F.col("ordinal").alias("centre"), F.explode(buckets).alias("__b"))
    placed = units.select("doc_id", "ordinal", "content", F.floor(F.col("ordinal") / width).alias("__u"))
    near = placed.join(centre, (F.col("doc_id") == F.col("__d")) & (F.col("__u") == F.col("__b")) & F.col("ordinal").between(F.col("centre") - window, F.col("centre") + window))
    return near.select("doc_id", "centre", "ordinal", "content")
