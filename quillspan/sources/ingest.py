"""Ingestion as one DataFrame pipeline: normalise, split, number, embed."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError, SchemaError
from ..functions.registry import Registry
from ..operators import text as text_ops
from ..operators.embed import Embedder, embed_cached, embed_column, embed_image_column
from .collection import PAYLOAD


class Pipeline:
    """``cache`` is the folder of the embedding cache: a text that was embedded once isn't again."""

    def __init__(self, registry: Registry, embedder: Embedder | None, granularity: str, normalizer: Callable[[Column], Column] | None = None, cache: str | None = None):
        self.registry, self.embedder, self.granularity, self.normalizer, self.cache = registry, embedder, granularity, normalizer, cache

    def frame(self, spark: SparkSession, rows: Sequence[Mapping[str, Any]]) -> DataFrame:
        """Documents given as mappings: doc_id, text or payloads, metadata, source."""
        out = []
        for r in rows:
            payloads = r.get("payloads") or ([{"modality": "text", "text": r["text"], "mime": "text/plain"}] if r.get("text") is not None else [])
            if not payloads:
                raise SchemaError("a document needs a payload")
            for p in payloads:
                if p.get("modality", "text") == "text" and not isinstance(p.get("text"), str):
                    raise SchemaError("a text payload needs text")
            full = [{"modality": "text", "text": None, "bytes": None, "uri": None, "mime": None} | dict(p) for p in payloads]
            out.append((r["doc_id"], full, json.dumps(r.get("metadata") or {}, ensure_ascii=False, default=str), r.get("source")))
        schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("payloads", T.ArrayType(PAYLOAD)), T.StructField("j", T.StringType()), T.StructField("source", T.StringType())])
        return spark.createDataFrame(out, schema).select("doc_id", "payloads", F.parse_json("j").alias("metadata"), "source")

    def _documents(self, documents: DataFrame) -> DataFrame:
        """With their number in the batch; of a document that comes several times the last."""
        docs = documents.select("doc_id", "payloads", "metadata", "source", F.monotonically_increasing_id().alias("doc_no"))
        if documents.groupBy("doc_id").count().where("count > 1").isEmpty():
            return docs  # the usual batch: contents needn't be shuffled
        last = docs.groupBy("doc_id").agg(F.max_by(F.struct("payloads", "metadata", "source", "doc_no"), "doc_no").alias("d"))
        return last.select("doc_id", "d.payloads", "d.metadata", "d.source", "d.doc_no")

    def _split(self, docs: DataFrame) -> DataFrame:
        """(doc_id, doc_no, metadata, p, ordinal, content): ordinals run through a document's payloads, in its own row."""
        ext = self.registry.get("splitter", self.granularity)
        if ext is None:
            raise PlanError(f"no splitter for {self.granularity}")
        none = F.array().cast("array<string>")
        texts = F.transform("payloads", lambda p: F.when(p["modality"] == "text", p["text"]))
        if self.normalizer is None:
            plain = F.transform(text_ops.nfc_all(texts), lambda t: text_ops.normalize(t, nfc=False))
        else:
            plain = _each(self.normalizer, docs, texts)
        docs = docs.withColumn("__texts", plain)
        if ext.build is not None:
            parts = F.transform("__texts", lambda t: F.coalesce(ext.build(t), none))
        else:
            parts = F.udf(lambda ts, f=ext.python: [None if t is None else list(f(t)) for t in ts], "array<array<string>>", useArrow=True)(F.col("__texts"))
        docs = docs.withColumn("__parts", parts)
        of = F.transform("payloads", lambda p, i: F.when(p["modality"] == "text", F.coalesce(F.get("__parts", i), none)).when(p["modality"] == "image", F.array(F.lit(""))).otherwise(none))
        flat = F.flatten(F.transform(of, lambda part, i: F.transform(part, lambda x: F.struct(i.alias("no"), x.alias("content")))))
        rows = docs.select("doc_id", "doc_no", "metadata", "payloads", F.posexplode(flat).alias("ordinal", "u"))
        return rows.select("doc_id", "doc_no", "metadata", F.get("payloads", F.col("u.no")).alias("p"), "ordinal", F.col("u.content").alias("content"))

    def run(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(documents, units) to be stored as one version."""
        docs = self._documents(documents)
        rows = self._split(docs)
        image = F.col("p.modality") == "image"
        if self.embedder is None:
            rows = rows.withColumn("vector", F.lit(None).cast("array<float>"))
        else:
            text = F.when(~image, F.col("content"))
            if self.cache:
                rows = embed_cached(rows.withColumn("__text", text), "__text", self.embedder, self.cache).drop("__text").withColumn("vector", F.when(~image, F.col("vector")))
            else:
                rows = rows.withColumn("vector", embed_column(text, self.embedder, keep_null=True))
            if hasattr(self.embedder, "embed_images"):
                seen = F.when(image, F.coalesce(F.col("p.bytes"), F.col("p.uri").cast("binary"), F.lit(b"")))
                rows = rows.withColumn("vector", F.coalesce("vector", embed_image_column(seen, self.embedder)))
        units = rows.select(
            F.concat("doc_id", F.lit(f"#{self.granularity}:"), F.col("ordinal").cast("string")).alias("unit_id"), "doc_id", F.lit(self.granularity).alias("kind"), "doc_no", "ordinal", "content",
            F.when(image, F.col("p")).otherwise(F.struct(F.lit("text").alias("modality"), F.col("content").alias("text"), F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast("string").alias("uri"), F.lit("text/plain").alias("mime"))).alias("payload"),
            "metadata", "vector", F.lit(None).cast("map<string,array<float>>").alias("vectors"),
        )
        return docs, units

    def unit_frame(self, spark: SparkSession, ident: str, content: str, vectors: Mapping[str, list[float]], metadata: Mapping[str, Any], kind: str) -> DataFrame:
        main = self.embedder.embed([content])[0].tolist() if self.embedder else None
        schema = "unit_id string, doc_id string, kind string, ordinal int, doc_no bigint, content string, j string, vector array<float>, vectors map<string,array<float>>"
        row = (ident, ident, kind, 0, 0, content, json.dumps(dict(metadata), default=str), main, dict(vectors))
        df = spark.createDataFrame([row], schema)
        payload = F.struct(F.lit("text").alias("modality"), F.col("content").alias("text"), F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast("string").alias("uri"), F.lit("text/plain").alias("mime"))
        return df.select("unit_id", "doc_id", "kind", "ordinal", "doc_no", "content", payload.alias("payload"), F.parse_json("j").alias("metadata"), "vector", "vectors")


def _each(normalizer: Callable[[Column], Column], docs: DataFrame, texts: Column) -> Column:
    """A user's normaliser on every text of an array; one that needs Python can't run inside the array."""
    out = F.transform(texts, normalizer)
    try:
        docs.select(out)
    except Exception as e:
        raise PlanError(f"a normaliser must be made of Spark functions alone: {e}") from e
    return out
