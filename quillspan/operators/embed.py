"""Embedding: the deterministic hash embedder, HTTP and model embedders behind one protocol, the cache table."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EmbeddingError

VECTOR = T.ArrayType(T.FloatType())


class Embedder(Protocol):
    """Driver and workers call the same method; rows come back in order, of unit length."""

    model_id: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class ImageEmbedder(Embedder, Protocol):
    def embed_images(self, images: list[bytes | str]) -> np.ndarray: ...


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays."""
    m = np.asarray(m, np.float32)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def unit_vector(v: Column) -> Column:
    """The same for a column of vectors of one size; null for null."""

    def run(a: pa.Array) -> pa.Array:
        there = np.asarray(a.is_valid())
        vec = a.drop_null()
        if not len(vec):
            return pa.nulls(len(a), pa.list_(pa.float32()))
        flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.concatenate(([0], np.cumsum(np.asarray(vec.value_lengths()))))
        norm = np.sqrt(np.add.reduceat(np.append(flat * flat, 0.0), ends[:-1])) if len(flat) else np.zeros(len(vec))
        norm = np.repeat(np.where(norm > 0, norm, 1), np.diff(ends))
        offsets = np.zeros(len(a) + 1, np.int64)
        offsets[1:][there] = np.diff(ends)
        mask = pa.array(np.append(~there, False))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(offsets), pa.int32(), mask=np.asarray(mask)), pa.array((flat / norm).astype(np.float32)))

    run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, VECTOR)(v)


@lru_cache(maxsize=200_000)
def _token_vector(token: str, dim: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.sha256(token.encode()).digest()[:8], "little")
    return np.random.default_rng(seed).standard_normal(dim).astype(np.float32)


class HashEmbedder:
    """No model: a text is the sum of its tokens' seeded random vectors; an image is the caption its bytes decode to."""

    def __init__(self, dim: int = 64, model_id: str = "hash"):
        self.dim, self.model_id = dim, f"{model_id}:{dim}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            low = (text or "").lower()
            for token in low.split() or [low]:
                row += _token_vector(token, self.dim)
        return unit_rows(out)

    def embed_images(self, images: list[bytes | str]) -> np.ndarray:
        return self.embed([i.decode("utf-8", "replace") if isinstance(i, bytes) else i for i in images])


class HttpEmbedder:
    """An embeddings endpoint of the common JSON form.  ``post(path, body) -> dict`` does the transport."""

    def __init__(self, model: str, dim: int, post: Callable[[str, dict[str, Any]], dict[str, Any]], batch: int = 64, dimensions: bool = True):
        self.model_id, self.dim, self._post, self._batch, self._dimensions = model, dim, post, batch, dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        rows: list[list[float]] = []
        for k in range(0, len(texts), self._batch):
            part = texts[k : k + self._batch]
            body = {"model": self.model_id, "input": part} | ({"dimensions": self.dim} if self._dimensions else {})
            data = self._post("/embeddings", body).get("data", [])
            if len(data) != len(part):
                raise EmbeddingError(f"{len(part)} texts, but {len(data)} vectors")
            rows += [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]
        return unit_rows(np.array(rows, np.float32).reshape(len(texts), -1 if rows else self.dim))


def image_uri(image: bytes | str) -> str:
    """What a multimodal endpoint takes: addresses as they are, bytes as a data URI of the sniffed type."""
    if isinstance(image, str):
        return image
    # The first bytes of image formats.
    kind = next((k for magic, k in ((b"\x89PNG", "png"), (b"\xff\xd8", "jpeg"), (b"GIF8", "gif"), (b"RIFF", "webp")) if image.startswith(magic)), "png")
    return f"data:image/{kind};base64,{base64.b64encode(image).decode()}"


class MultimodalHttpEmbedder(HttpEmbedder):
    """One request an input, text or image, to a multimodal endpoint."""

    def _one(self, part: dict[str, Any]) -> list[float]:
        data = self._post("/embeddings/multimodal", {"model": self.model_id, "input": [part]}).get("data")
        data = data[0] if isinstance(data, list) and data else data
        if not isinstance(data, dict) or "embedding" not in data:
            raise EmbeddingError("no vector in the answer")
        return data["embedding"]

    def embed(self, texts: list[str]) -> np.ndarray:
        return unit_rows(np.array([self._one({"type": "text", "text": t}) for t in texts], np.float32).reshape(len(texts), -1 if texts else self.dim))

    def embed_images(self, images: list[bytes | str]) -> np.ndarray:
        return unit_rows(np.array([self._one({"type": "image_url", "image_url": {"url": image_uri(i)}}) for i in images], np.float32).reshape(len(images), -1 if images else self.dim))


class LocalModelEmbedder:
    """A sentence-transformers model, loaded once a worker on first use (optional library)."""

    def __init__(self, model: str, dim: int):
        self.model_id, self.dim, self._model = model, dim, None

    def __getstate__(self) -> dict[str, Any]:
        return self.__dict__ | {"_model": None}

    def _load(self) -> Any:
        if self._model is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise EmbeddingError("sentence-transformers isn't installed") from e
            self._model = SentenceTransformer(self.model_id)
        return self._model

    def embed(self, texts: list[str]) -> np.ndarray:
        return unit_rows(self._load().encode(texts, convert_to_numpy=True)) if texts else np.zeros((0, self.dim), np.float32)

    def embed_images(self, images: list[bytes | str]) -> np.ndarray:
        import io

        from PIL import Image

        return unit_rows(self._load().encode([Image.open(io.BytesIO(i) if isinstance(i, bytes) else i) for i in images], convert_to_numpy=True))


def _of_present(embed: Callable[[list], np.ndarray], s: pd.Series) -> pd.Series:
    """Vectors of the rows that aren't null; the others have none and aren't sent to the model."""
    out: list[np.ndarray | None] = [None] * len(s)
    at = np.flatnonzero(s.notna().to_numpy())
    if len(at):
        for i, v in zip(at, embed(s.iloc[at].tolist())):
            out[i] = v
    return pd.Series(out, dtype=object)


def embed_column(text: Column, embedder: Embedder, keep_null: bool = False) -> Column:
    """Vectors of a text column, one Arrow batch at a time; null counts as an empty text or stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield _of_present(embedder.embed, s if keep_null else s.fillna(""))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, VECTOR)(text)


def embed_image_column(image: Column, embedder: ImageEmbedder) -> Column:
    """The same for images; null stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield _of_present(embedder.embed_images, s)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, VECTOR)(image)


def cache_key(text: Column, embedder: Embedder, modality: str = "text") -> Column:
    """Content address: model, size, modality and text."""
    return F.sha2(F.concat_ws("\x00", F.lit(embedder.model_id), F.lit(str(embedder.dim)), F.lit(modality), text), 256)


def driver_key(text: str, embedder: Embedder, modality: str = "text") -> str:
    return hashlib.sha256("\x00".join((embedder.model_id, str(embedder.dim), modality, text)).encode()).hexdigest()


def embed_cached(df: DataFrame, text: str, embedder: Embedder, cache_path: str, vector: str = "vector") -> DataFrame:
    """Vectors from the cache table where they are; each missing text is embedded once and appended to it."""
    spark = df.sparkSession
    keyed = df.withColumn("__key", cache_key(F.coalesce(F.col(text), F.lit("")), embedder))
    where = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        have = spark.read.schema("key string, vector array<float>").parquet(cache_path)
    else:
        have = spark.createDataFrame([], "key string, vector array<float>")
    missing = keyed.select("__key", F.coalesce(F.col(text), F.lit("")).alias("t")).groupBy("__key").agg(F.first("t").alias("t"))
    missing = missing.join(have, missing["__key"] == have["key"], "left_anti")
    missing.select(F.col("__key").alias("key"), embed_column(F.col("t"), embedder).alias("vector")).write.mode("append").parquet(cache_path)
    known = spark.read.schema("key string, vector array<float>").parquet(cache_path).dropDuplicates(["key"])
    return keyed.join(known.select(F.col("key").alias("__key"), F.col("vector").alias(vector)), "__key", "left").drop("__key")
