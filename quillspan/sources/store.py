"""A collection's storage: versions in Parquet folders, each committed by a manifest that is written last."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ExecutionError, SchemaError
from ..operators.vectors import CellIndex, top_k
from ..plans.analyze import PROFILES, Profile
from .collection import Collection

_PAYLOAD = "struct<modality:string,text:string,bytes:binary,uri:string,mime:string>"
UNITS_SCHEMA = f"unit_id string, doc_id string, kind string, version bigint, doc_no bigint, ordinal int, content string, payload {_PAYLOAD}, metadata variant, vector array<float>, vectors map<string,array<float>>"
DOCS_SCHEMA = f"doc_id string, version bigint, doc_no bigint, payloads array<{_PAYLOAD}>, metadata variant, source string"


class Source(Protocol):
    """What an engine needs of a storage: the collection, and a filtered scan or top-k of its units."""

    def collection(self, granularity: str, vector_names: Sequence[str] = (), profile: Profile = ...) -> Collection: ...

    def scan(self, condition: Column | None = None) -> DataFrame: ...

    def top_k(self, query: Sequence[float], k: int, condition: Column | None = None) -> DataFrame: ...


class Files:
    """The few file operations that a store needs, on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def create(self, name: str, content: str | bytes = "") -> bool:
        """A new file; False if it is there already."""
        try:
            out = self._fs.create(self._path(name), False)
        except Exception as e:  # the JVM's, by name only
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(content.encode() if isinstance(content, str) else content))
        out.close()
        return True

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


class Store:
    """Documents and units by version; adding a document again replaces all units of the older one.

    A writer claims the next version number by creating a file, writes its folders and
    commits them by a manifest; readers see committed versions only, and a version that
    was never committed is passed over.  A manifest says how many documents its version
    replaced: while none did (also after ``compact``), reading is a plain scan; else the
    replaced ones leave by an anti join with their ids, which Catalyst broadcasts where
    they are few.  Contents are never shuffled for that.

    ``fields`` declares metadata fields that queries filter by (name to Spark type): they
    are stored as columns of their own, so that conditions on them reach the scan.
    """

    def __init__(self, spark: SparkSession, path: str, fields: Mapping[str, str] | None = None):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self._read: dict[str, dict[str, Any]] = {}  # manifests never change
        if self.files.exists("store.json"):
            kept = json.loads(self.files.read("store.json"))["fields"]
            if fields is not None and dict(fields) != kept:
                raise SchemaError(f"the store was made with the fields {kept}")
            self.fields = kept
        else:
            self.fields = dict(fields or {})

    # versions

    def manifests(self) -> list[dict[str, Any]]:
        names = [n for n in self.files.names("manifests") if n.endswith(".json")]
        for n in names:
            if n not in self._read:
                self._read[n] = json.loads(self.files.read(f"manifests/{n}"))
        return [self._read[n] for n in names]

    def next_seq(self) -> int:
        """The version that the next writer gets."""
        return max((int(n) for n in self.files.names("claims")), default=-1) + 1

    def _claim(self) -> int:
        self.files.create("store.json", json.dumps({"fields": self.fields}))
        while True:
            v = self.next_seq()
            if self.files.create(f"claims/{v:08d}"):
                return v

    def _folders(self, name: str, manifests: Sequence[Mapping[str, Any]]) -> list[str]:
        return [f"{self.path}/{name}/{m['version']:08d}" for m in manifests if name in m["folders"]]

    def _columns(self) -> str:
        return "".join(f", `m_{n}` {t}" for n, t in self.fields.items())

    # writing

    def append(self, documents: DataFrame | None, units: DataFrame, require_vectors: bool = False) -> int:
        """One version: documents (doc_id, doc_no, payloads, metadata, source) and their units, all or nothing."""
        v = self._claim()
        done = self.manifests()
        own = [F.try_variant_get("metadata", "$." + n, t).alias(f"m_{n}") for n, t in self.fields.items()]
        folders = ["units", "ids"]
        at = {name: f"{self.path}/{name}/{v:08d}" for name in ("units", "documents", "ids", "replaced")}
        names = [c.split()[0] for c in UNITS_SCHEMA.replace(_PAYLOAD, "x").split(", ")]
        units.withColumn("version", F.lit(v).cast("bigint")).select(*names, *own).write.parquet(at["units"])
        ids = self.spark.read.parquet(at["units"]).select("doc_id")
        if documents is not None:
            folders.append("documents")
            names = [c.split()[0] for c in DOCS_SCHEMA.replace(_PAYLOAD, "x").split(", ")]
            documents.withColumn("version", F.lit(v).cast("bigint")).select(*names, *own).write.parquet(at["documents"])
            ids = ids.unionByName(self.spark.read.parquet(at["documents"]).select("doc_id"))
        dim = self._check_vectors(at["units"], done, require_vectors)
        ids.distinct().write.parquet(at["ids"])
        replaced = 0
        before = self._folders("ids", done)
        if before:
            again = self.spark.read.parquet(at["ids"]).join(self.spark.read.parquet(*before).distinct(), "doc_id", "left_semi")
            again.select("doc_id", F.lit(v).cast("bigint").alias("before")).write.parquet(at["replaced"])
            replaced = self.spark.read.parquet(at["replaced"]).count()
            if replaced:
                folders.append("replaced")
        self.files.create(f"manifests/{v:08d}.json", json.dumps({"version": v, "folders": folders, "replaced": replaced, "dim": dim}))
        return v

    def _check_vectors(self, units: str, done: Sequence[Mapping[str, Any]], require: bool) -> int | None:
        """Every vector of the store has one size; nothing is committed else."""
        low, high, rows, there = self.spark.read.parquet(units).agg(F.min(F.size("vector")), F.max(F.size("vector")), F.count("*"), F.count("vector")).first()
        if require and there < rows:
            raise ExecutionError(f"{rows - there} units have no vector")
        if not there:
            return None
        low = self.spark.read.parquet(units).where("vector is not null").agg(F.min(F.size("vector"))).first()[0] if there < rows else low
        known = next((m["dim"] for m in done if m["dim"]), high)
        if low != high or high != known:
            raise ExecutionError(f"vectors must have {known} numbers, not {low if low != known else high}")
        return high

    # reading

    def _current(self, name: str, schema: str) -> DataFrame:
        done = self.manifests()
        folders = self._folders(name, done)
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*folders)
        replaced = self._folders("replaced", done)
        if not replaced:
            return rows
        stale = self.spark.read.parquet(*replaced).groupBy(F.col("doc_id").alias("__id")).agg(F.max("before").alias("__before"))
        return rows.join(stale, (F.col("doc_id") == F.col("__id")) & (F.col("version") < F.col("__before")), "left_anti")

    def documents(self) -> DataFrame:
        return self._current("documents", DOCS_SCHEMA + self._columns())

    def units(self) -> DataFrame:
        """With ``seq``, by which they stand in the order of their adding."""
        return self._current("units", UNITS_SCHEMA + self._columns()).withColumn("seq", F.struct("version", "doc_no", "ordinal"))

    def scan(self, condition: Column | None = None) -> DataFrame:
        return self.units() if condition is None else self.units().where(condition)

    def top_k(self, query: Sequence[float], k: int, condition: Column | None = None) -> DataFrame:
        return top_k(self.scan(condition).where(F.col("vector").isNotNull()), "vector", query, k, ("seq", "unit_id"))

    def document(self, doc_id: str) -> DataFrame:
        return self.documents().where(F.col("doc_id") == doc_id)

    def neighbours(self, doc_id: str, ordinal: int, window: int) -> DataFrame:
        u = self.units()
        return u.where((F.col("doc_id") == doc_id) & F.col("ordinal").between(ordinal - window, ordinal + window)).orderBy("ordinal")

    def count(self) -> int:
        return self.units().count()

    def compact(self, target: str) -> Store:
        """The current state alone, in another folder, as one version."""
        out = Store(self.spark, target, self.fields)
        out.files.create("store.json", json.dumps({"fields": self.fields}))
        v = max((m["version"] for m in self.manifests()), default=0)
        out.files.create(f"claims/{v:08d}")
        units, documents = f"{out.path}/units/{v:08d}", f"{out.path}/documents/{v:08d}"
        self.units().drop("seq").write.parquet(units)
        self.documents().write.parquet(documents)
        ids = self.spark.read.parquet(units).select("doc_id").unionByName(self.spark.read.parquet(documents).select("doc_id"))
        ids.distinct().write.parquet(f"{out.path}/ids/{v:08d}")
        dim = next((m["dim"] for m in self.manifests() if m["dim"]), None)
        out.files.create(f"manifests/{v:08d}.json", json.dumps({"version": v, "folders": ["units", "documents", "ids"], "replaced": 0, "dim": dim}))
        return out

    # approximate recall

    def build_cells(self, cells: int = 64, probes: int = 8, sample: int = 200_000) -> CellIndex:
        """A layout of the current units by cells, for collections of a profile that isn't exact."""
        v = max((m["version"] for m in self.manifests()), default=0)
        made = CellIndex.build(self.units().where(F.col("vector").isNotNull()), "vector", f"{self.path}/cells/{v:08d}-{len(self.files.names('cells')):04d}", cells, sample)
        made.probes = probes
        self.files.create(f"cell_indexes/{v:08d}-{len(self.files.names('cell_indexes')):04d}.json", json.dumps(made.to_json() | {"version": v}))
        return made

    def _cells(self) -> tuple[CellIndex | None, DataFrame | None]:
        """The last layout, and the units added since; none if it holds documents that were replaced since."""
        names = self.files.names("cell_indexes")
        if not names:
            return None, None
        d = json.loads(self.files.read(f"cell_indexes/{names[-1]}"))
        later = [m for m in self.manifests() if m["version"] > d["version"]]
        if any(m["replaced"] for m in later):
            return None, None
        return CellIndex.from_json(d), self.units().where(F.col("version") > d["version"]) if later else None

    def collection(self, granularity: str, vector_names: Sequence[str] = (), profile: Profile = PROFILES["local"]) -> Collection:
        units = self.units()
        for n in vector_names:
            units = units.withColumn(f"v_{n}", F.try_element_at("vectors", F.lit(n)))
        text = F.array_join(F.transform(F.filter("payloads", lambda p: p["modality"] == "text"), lambda p: p["text"]), " ")
        columns = [f"m_{n}" for n in self.fields]
        docs = self.documents().select("doc_id", text.alias("content"), "metadata", *columns)
        cells, newer = (None, None) if profile.exact or vector_names else self._cells()
        return Collection(units, granularity, {n: f"m_{n}" for n in self.fields}, "metadata", {"default": "vector"} | {n: f"v_{n}" for n in vector_names}, docs, profile, cells, newer)
