"""The engine: a collection, an embedder and a registry behind ``search``."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from .builder import Builder
from .errors import PlanError
from .functions import builtins as _builtins  # noqa: F401  (registers the functions)
from .functions.registry import GLOBAL, Registry, Signature
from .functions.types import handler_of
from .operators.embed import Embedder
from .operators.rerank import Reranker
from .operators.text import by_script
from .plans import plan
from .plans.analyze import PROFILES, Analyzed, Profile, analyze
from .plans.ir import Query
from .plans.parse import parse
from .plans.schema import query_schema, tool
from .ship import ship
from .sources.collection import Collection
from .sources.ingest import Pipeline
from .sources.store import Store


class Engine:
    """Searches a collection given as it is, or one that it keeps in a Store.

    ``field_types`` declares the type of metadata fields (text, number, date or a
    registered one).  ``strict`` makes an ordered comparison of incomparable values an
    error; otherwise it is false.  ``insertion_order=True`` sorts also the rows of a query
    without ORDER BY, similarity or LIMIT, which shuffles the result.  ``profile`` is the
    layout that a store's collection has: one that isn't exact searches its cells
    (``store.build_cells``).  ``embedding_cache`` is a folder of vectors that ingestion
    looks texts up in; ``script_splitters`` are splitters by script (cjk, latin, default).
    """

    def __init__(
        self,
        spark: SparkSession,
        collection: Collection | None = None,
        *,
        store: Store | None = None,
        embedder: Embedder | None = None,
        named_embedders: Mapping[str, Embedder] | None = None,
        granularity: str = "chunk",
        field_types: Mapping[str, str] | None = None,
        normalizer: Any = None,
        reranker: Reranker | None = None,
        rerank_factor: int = 5,
        strict: bool = True,
        insertion_order: bool = False,
        registry: Registry | None = None,
        profile: Profile = PROFILES["local"],
        embedding_cache: str | None = None,
        script_splitters: Mapping[str, Callable[[Column], Column]] | None = None,
    ):
        if collection is None and store is None:
            raise PlanError("an engine needs a collection or a store")
        self.spark, self._collection, self.store = ship(spark), collection, store
        self.embedder, self.named_embedders = embedder, dict(named_embedders or {})
        self.granularity = collection.granularity if collection else granularity
        self.field_types = dict(field_types or {})
        self.reranker, self.rerank_factor, self.strict, self.insertion_order = reranker, rerank_factor, strict, insertion_order
        self.registry = registry or GLOBAL.child()
        self.profile = profile
        if script_splitters:
            self.registry.splitter(self.granularity, build=by_script(**script_splitters), overwrite=True)
        self.pipeline = Pipeline(self.registry, embedder, self.granularity, normalizer, embedding_cache)
        self._vector_names: set[str] = set(self.named_embedders)
        self._query_vectors: dict[tuple[str, str], list[float]] = {}

    # reading

    @property
    def collection(self) -> Collection:
        if self._collection is not None:
            return self._collection
        return self.store.collection(self.granularity, sorted(self._vector_names), self.profile)

    def query(self, q: str | Query | Builder | Mapping[str, Any], limit: int | None = None) -> Query:
        """Any front end's query as nodes; a limit overrides its own."""
        if isinstance(q, str):
            q = parse(q)
        elif isinstance(q, Builder):
            q = q.build()
        elif isinstance(q, Mapping):
            q = Query.from_dict(dict(q))
        return q if limit is None else replace(q, limit=limit)

    def _analyze(self, q: Query, c: Collection) -> Analyzed:
        return analyze(q, self.registry, c.profile, self.field_types)

    def _vector(self, name: str, text: str) -> list[float]:
        e = self.named_embedders.get(name, self.embedder)
        if e is None:
            raise PlanError("the engine has no embedder for query texts")
        key = e.model_id, text
        if key not in self._query_vectors:
            self._query_vectors[key] = [float(x) for x in e.embed([text])[0]]
        return self._query_vectors[key]

    def search(self, q: str | Query | Builder | Mapping[str, Any], limit: int | None = None, *, vectors: Mapping[str, Sequence[float]] | None = None, rerank_query: str | None = None, reranker: Reranker | None = None) -> DataFrame:
        """One lazy DataFrame: unit_id, doc_id, kind, ordinal, content, LET names, metadata; in rank order.

        ``vectors`` gives the query vector of a similarity's text directly, without an embedder.
        """
        c = self.collection
        a = self._analyze(self.query(q, limit), c)
        given = vectors or {}
        query_vectors = {k: list(given[s.text]) if s.text in given else self._vector(s.vector, s.text) for k, s in a.scorers.items()}
        settings = plan.Settings(self.registry, self.field_types, self.strict, reranker or self.reranker, rerank_query, self.rerank_factor, self.insertion_order)
        return plan.build(a, c, query_vectors, settings)

    def search_ir(self, document: Mapping[str, Any], limit: int | None = None) -> DataFrame:
        return self.search(document, limit)

    def explain(self, q: str | Query | Builder | Mapping[str, Any], physical: bool = False, vectors: Mapping[str, Sequence[float]] | None = None) -> dict[str, Any]:
        """What the query will do, without running it."""
        query = self.query(q)
        c = self.collection
        a = self._analyze(query, c)
        plan.check_granularity(query, c.granularity)
        names = {s.key: n for n, e in query.let for s in a.scorers.values() if getattr(e, "key", None) == s.key}
        named = any(s.vector != "default" for s in a.scorers.values())
        recall = "scan" if not a.scorers else "approximate-top-k" if plan.approximate(a, c) else "scored-scan" if named else "exact-top-k" if query.limit is not None else "exact-all"
        out: dict[str, Any] = {
            "ir": query.to_dict(),
            "select": {"unit": query.select.unit, "window": query.select.window},
            "granularity": c.granularity,
            "store": c.profile.name,
            "scores": [{"alias": names.get(s.key), "query": s.text, "vector": s.vector} for s in a.scorers.values()],
            "bindings": [n for n, _ in query.let],
            "filter": {"pushed": a.pushed and a.pushed.to_dict(), "residual": a.residual and a.residual.to_dict()},
            "order_by": [{"expr": k.expr.to_dict(), "desc": k.desc} for k in query.order_by],
            "limit": query.limit,
            "recall": recall,
        }
        if self.reranker is not None and a.scorers:
            out["rerank"] = {"reranker": type(self.reranker).__name__, "factor": self.rerank_factor}
        if physical:
            out["physical"] = self.search(query, vectors=vectors)._jdf.queryExecution().toString()
        return out

    def schema(self) -> dict[str, Any]:
        return query_schema(self.registry.names("function"))

    def tool(self, name: str = "retrieval_query", description: str | None = None) -> dict[str, Any]:
        return tool(self.registry.names("function"), name, description)

    def __len__(self) -> int:
        return self.collection.units.count()

    # extending

    def register_function(self, name: str, signature: Signature | None = None, **how: Any) -> Any:
        return self.registry.function(name, signature, **how)

    def register_splitter(self, name: str, **how: Any) -> Any:
        return self.registry.splitter(name, **how)

    def register_type(self, name: str, handler: Any = None, **how: Any) -> Any:
        if handler is not None:
            handler_of(name, handler)
        return self.registry.type(name, handler, **how)

    # writing

    def _writable(self) -> Store:
        if self.store is None:
            raise PlanError("this engine searches a given collection; it has no store to write to")
        return self.store

    def add_documents(self, documents: DataFrame | Iterable[Mapping[str, Any]]) -> list[str]:
        """Add or replace documents (doc_id, payloads or text, metadata, source); returns the ids of given rows."""
        store = self._writable()
        ids: list[str] = []
        if not isinstance(documents, DataFrame):
            rows = [dict(d) for d in documents]
            for r in rows:
                r.setdefault("doc_id", uuid.uuid4().hex)
            ids = [r["doc_id"] for r in rows]
            documents = self.pipeline.frame(self.spark, rows)
        docs, units = self.pipeline.run(documents)
        store.append(docs, units)
        return list(dict.fromkeys(ids))

    def add_text(self, text: str, metadata: Mapping[str, Any] | None = None, doc_id: str | None = None) -> str:
        return self.add_documents([{"text": text, "metadata": dict(metadata or {})} | ({"doc_id": doc_id} if doc_id else {})])[0]

    def add_image(self, image: bytes | str, metadata: Mapping[str, Any] | None = None, doc_id: str | None = None, mime: str | None = None) -> str:
        """Bytes, a local path (read now) or an address (kept)."""
        if isinstance(image, str) and "://" not in image and not image.startswith("data:"):
            with open(image, "rb") as f:
                image = f.read()
        payload = {"modality": "image", "mime": mime} | ({"bytes": image} if isinstance(image, bytes) else {"uri": image})
        return self.add_documents([{"payloads": [payload], "metadata": dict(metadata or {})} | ({"doc_id": doc_id} if doc_id else {})])[0]

    def add_files(self, paths: str | Sequence[str], loader: str | None = None, metadata: Mapping[str, Any] | None = None, **options: Any) -> list[str]:
        from .sources.files import load_documents

        ids: list[str] = []
        for path in [paths] if isinstance(paths, str) else paths:
            self.add_documents(load_documents(self.spark, path, loader, metadata, **options))
            # the ids that were stored; the files aren't read again
            ids += [r.doc_id for r in self.spark.read.parquet(f"{self.store.path}/documents/{self.store.manifests()[-1]['version']:08d}").select("doc_id").orderBy("doc_id").collect()]
        return ids

    add_file = add_files

    def add_multivector(self, ident: str, content: str, named: Mapping[str, str | bytes], metadata: Mapping[str, Any] | None = None, kind: str | None = None) -> str:
        """One unit without a document, with a vector for each name by its own embedder."""
        store = self._writable()
        vectors = {}
        for name, value in named.items():
            e = self.named_embedders.get(name, self.embedder)
            vectors[name] = (e.embed_images([value]) if isinstance(value, bytes) else e.embed([value]))[0].tolist()
            self._vector_names.add(name)
        units = self.pipeline.unit_frame(self.spark, ident, content, vectors, metadata or {}, kind or self.granularity)
        store.append(None, units)
        return ident
