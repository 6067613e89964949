"""File sources: a reader for each extension, giving (doc_id, payloads, metadata, source)."""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Callable, Iterator, Mapping
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RegistryError
from .collection import PAYLOAD

Loader = Callable[..., DataFrame]
_LOADERS: dict[str, Loader] = {}
_NAMED: dict[str, Loader] = {}


def register_loader(name: str, loader: Loader, *extensions: str) -> None:
    _NAMED[name] = loader
    for e in extensions:
        _LOADERS[e.lower()] = loader


def loader_for(path: str) -> Loader:
    ext = os.path.splitext(path)[1].lower()
    if ext not in _LOADERS:
        raise RegistryError(f"no loader for {ext or path!r}; there are {', '.join(sorted(_LOADERS))}")
    return _LOADERS[ext]


def load_documents(spark: SparkSession, path: str, loader: str | Loader | None = None, metadata: Mapping[str, Any] | None = None, **options: Any) -> DataFrame:
    """Documents of a file, folder or pattern; ``metadata`` is added to each."""
    f = loader if callable(loader) else _NAMED[loader] if loader else loader_for(path)
    df = f(spark, path, **options)
    if metadata:
        # given values keep their types
        given = F.create_map(*[x for k, v in metadata.items() for x in (F.lit(k), F.parse_json(F.lit(json.dumps(v, default=str))))])
        own = F.transform_values("metadata", lambda _, v: v.cast("variant"))
        return df.withColumn("metadata", F.to_variant_object(F.map_zip_with(own, given, lambda _, a, b: F.coalesce(b, a))))
    return df.withColumn("metadata", F.parse_json(F.to_json("metadata")))


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def _text_payload(text: Column, mime: str) -> Column:
    return F.array(F.struct(F.lit("text").alias("modality"), text.alias("text"), F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast("string").alias("uri"), F.lit(mime).alias("mime")).cast(PAYLOAD))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """A whole file is a document, named by its stem."""
    df = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return df.select(_stem(F.col("path")).alias("doc_id"), _text_payload(F.col("value"), "text/plain").alias("payloads"), F.create_map(F.lit("source"), F.col("path")).alias("metadata"), F.col("path").alias("source"))


def docx_text(data: bytes) -> str:
    """Paragraphs that aren't blank, by lines."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{ns}t")) for p in root.iter(f"{ns}p"))
    return "\n".join(x for x in lines if x.strip())


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(docx_text)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    df = spark.read.format("binaryFile").load(path).select("path", F.pandas_udf(run, "string")(F.col("content")).alias("value"))
    return df.select(_stem(F.col("path")).alias("doc_id"), _text_payload(F.col("value"), "text/plain").alias("payloads"), F.create_map(F.lit("source"), F.col("path")).alias("metadata"), F.col("path").alias("source"))


def pdf_parts(data: bytes) -> tuple[list[str], list[bytes]]:
    """(text of each page, embedded images)."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RegistryError("reading PDF needs pypdf, which isn't installed") from e
    reader = PdfReader(io.BytesIO(data))
    pages = [p.extract_text() or "" for p in reader.pages]
    return pages, [i.data for p in reader.pages for i in p.images]


def pdf_files(spark: SparkSession, path: str, by_page: bool = False, images: bool = False) -> DataFrame:
    """Whole documents, a document for each page that isn't blank, or one with its images as payloads."""
    schema = "doc_id string, payloads array<struct<modality:string,text:string,bytes:binary,uri:string,mime:string>>, metadata map<string,string>, source string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"]):
                pages, pics = pdf_parts(bytes(data))
                stem = os.path.splitext(os.path.basename(p))[0]
                text = lambda t: {"modality": "text", "text": t, "bytes": None, "uri": None, "mime": "text/plain"}
                if by_page:
                    rows += [(f"{stem}#p{i}", [text(t)], {"source": p, "page": str(i)}, p) for i, t in enumerate(pages, 1) if t.strip()]
                    continue
                payloads = [text("\n".join(pages))]
                meta = {"source": p, "pages": str(len(pages))}
                if images:
                    payloads += [{"modality": "image", "text": None, "bytes": b, "uri": None, "mime": "image/png"} for b in pics]
                    meta["images"] = str(len(pics))
                rows.append((stem, payloads, meta, p))
            yield pd.DataFrame(rows, columns=["doc_id", "payloads", "metadata", "source"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Each image file is a document with one image payload."""
    df = spark.read.format("binaryFile").load(path)
    payload = F.array(F.struct(F.lit("image").alias("modality"), F.lit(None).cast("string").alias("text"), F.col("content").alias("bytes"), F.lit(None).cast("string").alias("uri"), F.lit("image/png").alias("mime")).cast(PAYLOAD))
    return df.select(_stem(F.col("path")).alias("doc_id"), payload.alias("payloads"), F.create_map(F.lit("source"), F.col("path")).alias("metadata"), F.col("path").alias("source"))


register_loader("text", text_files, ".txt", ".md", ".markdown", ".text")
register_loader("docx", docx_files, ".docx")
register_loader("pdf", pdf_files, ".pdf")
register_loader("image", image_files, ".png", ".jpg", ".jpeg", ".gif", ".webp")
