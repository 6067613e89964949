"""What needs a library or a service that may be missing: with a stand-in of its interface, and without."""

import json
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.engine import Engine
from quillspan.errors import EmbeddingError, RegistryError
from quillspan.operators.embed import HashEmbedder, LocalModelEmbedder
from quillspan.operators.rerank import CrossEncoder
from quillspan.operators.text import pysbd_sentences
from quillspan.sources import files, remote
from quillspan.sources.collection import Collection, jdbc_scan
from quillspan.sources.store import Source, Store


def module(monkeypatch, name, **members):
    m = types.ModuleType(name)
    m.__dict__.update(members)
    monkeypatch.setitem(sys.modules, name, m)


class Page:
    def __init__(self, text, images=()):
        self.text, self.images = text, [types.SimpleNamespace(data=i) for i in images]

    def extract_text(self):
        return self.text


class Reader:
    def __init__(self, stream):
        self.pages = [Page("First page."), Page(" "), Page(stream.read().decode(), (b"png",))]


def test_pdf_parts(monkeypatch):
    monkeypatch.setitem(sys.modules, "pypdf", None)
    with pytest.raises(RegistryError, match="pypdf"):
        files.pdf_parts(b"x")
    module(monkeypatch, "pypdf", PdfReader=Reader)
    assert files.pdf_parts(b"Third.") == (["First page.", " ", "Third."], [b"png"])


def test_pdf_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "pdf_parts", lambda data: (["First page.", " ", data.decode()], [b"png"]))
    (tmp_path / "a.pdf").write_bytes(b"Third.")
    whole = files.load_documents(spark, str(tmp_path / "a.pdf"), images=True).selectExpr("doc_id", "payloads", "variant_get(metadata, '$.pages', 'int') as pages").first()
    assert (whole.doc_id, whole.pages) == ("a", 3) and [p.modality for p in whole.payloads] == ["text", "image"] and whole.payloads[0].text == "First page.\n \nThird."
    pages = files.load_documents(spark, str(tmp_path / "a.pdf"), by_page=True).orderBy("doc_id").collect()
    assert [(r.doc_id, r.payloads[0].text) for r in pages] == [("a#p1", "First page."), ("a#p3", "Third.")]


def test_local_models(monkeypatch):
    monkeypatch.setitem(sys.modules, "sentence_transformers", None)
    with pytest.raises(EmbeddingError):
        LocalModelEmbedder("m", 2).embed(["x"])

    class Model:
        def __init__(self, name):
            self.name = name

        def encode(self, texts, convert_to_numpy):
            return np.array([[3.0, 4.0]] * len(texts))

    class Pairs:
        def __init__(self, name):
            self.name = name

        def predict(self, pairs):
            return np.array([float(len(b)) for _, b in pairs])

    module(monkeypatch, "sentence_transformers", SentenceTransformer=Model, CrossEncoder=Pairs)
    e = LocalModelEmbedder("m", 2)
    assert np.allclose(e.embed(["x", "y"]), [[0.6, 0.8]] * 2) and e.embed([]).shape == (0, 2)
    assert e.__getstate__()["_model"] is None
    ranker = CrossEncoder("m")
    assert ranker.predict([("q", "abc"), ("q", "")]).tolist() == [3.0, 0.0] and ranker.__getstate__()["_loaded"] is None


def test_pysbd(monkeypatch):
    monkeypatch.setitem(sys.modules, "pysbd", None)
    with pytest.raises(RegistryError, match="pysbd"):
        pysbd_sentences()("One. Two.")

    class Segmenter:
        def __init__(self, language, clean):
            assert (language, clean) == ("de", False)

        def segment(self, text):
            return [s + ". " for s in text.rstrip(".").split(". ")]

    module(monkeypatch, "pysbd", Segmenter=Segmenter)
    assert pysbd_sentences("de")("Eins. Zwei.") == ["Eins.", "Zwei."]


def test_relational_tables(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(20).selectExpr("id as n", "id % 3 as k").write.format("jdbc").options(url=url, dbtable="t", **driver).save()
    df = jdbc_scan(spark, url, "t", "\"k\" = 1", **driver)
    assert sorted(r.n for r in df.collect()) == [1, 4, 7, 10, 13, 16, 19]
    split = jdbc_scan(spark, url, "t", **driver, partitionColumn="n", lowerBound=0, upperBound=20, numPartitions=4)
    assert split.rdd.getNumPartitions() == 4 and split.count() == 20


def test_a_storage_of_one_s_own(spark, tmp_path):
    """Whatever has the protocol's methods serves an engine."""

    class Fixed:
        def __init__(self, inner):
            self.inner = inner

        def collection(self, granularity, vector_names=(), profile=None):
            return self.inner.collection(granularity, vector_names)

        def scan(self, condition=None):
            return self.inner.scan(condition)

        def top_k(self, query, k, condition=None):
            return self.inner.top_k(query, k, condition)

    store = Store(spark, str(tmp_path))
    Engine(spark, store=store, granularity="sentence").add_text("One. Two.", doc_id="a")
    own: Source = Fixed(store)
    assert [r.content for r in Engine(spark, store=own, granularity="sentence").search("SELECT SENTENCE ORDER BY content").collect()] == ["One.", "Two."]
    assert own.scan().count() == 2


def records():
    e = HashEmbedder(16)
    texts = [f"word{i} item{i % 5}" for i in range(30)]
    meta = [({"status": "p" if i % 3 else "d"} if i % 10 else {}) | {"year": 2000 + i, "n": str(i)} for i in range(30)]
    return [{"unit_id": f"u{i:02d}", "doc_id": f"u{i:02d}", "ordinal": 0, "seq": i, "content": t, "metadata": m, "vector": v.tolist()} for i, (t, m, v) in enumerate(zip(texts, meta, e.embed(texts)))]


QUERIES = [
    ('SELECT CHUNK LET r = SIMILARITY(content, "word7 item2") WHERE meta.status == "p" AND meta.year >= 2005 ORDER BY r DESC LIMIT 5', True),
    ('SELECT CHUNK LET r = SIMILARITY(content, "word7 item2") WHERE meta.status == "p" AND content CONTAINS "ITEM2" LIMIT 4', None),
    ('SELECT CHUNK WHERE meta.status == "p" AND (meta.year < 2009 OR NOT meta.year <= 2020) ORDER BY meta.year', False),
    ('SELECT CHUNK LET r = SIMILARITY(content, "word7 item2") WHERE meta.status != "p" LIMIT 7', None),
    ('SELECT CHUNK WHERE LENGTH(content) > 11 AND meta.status != "p" ORDER BY content', False),
]


@pytest.mark.parametrize(("query", "ranked"), QUERIES)
def test_other_systems_find_the_same(spark, query, ranked):
    """A database of the relational form and a service of the other one, against a local collection."""
    import duckdb

    rows = records()
    e = HashEmbedder(16)
    local = spark.createDataFrame([(*[r[k] for k in ("unit_id", "doc_id", "ordinal", "seq", "content")], json.dumps(r["metadata"]), r["vector"]) for r in rows], remote.ROWS).withColumn("metadata", F.parse_json("metadata"))
    want = [r.unit_id for r in Engine(spark, Collection(local, "chunk", {}, "metadata", {"default": "vector"}), embedder=e).search(query).collect()]
    assert want
    con = duckdb.connect()
    con.execute("CREATE TABLE t (unit_id VARCHAR, doc_id VARCHAR, ordinal INT, seq BIGINT, content VARCHAR, metadata JSON, vector FLOAT[16])")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?, ?)", [[r[k] if k != "metadata" else json.dumps(r[k]) for k in ("unit_id", "doc_id", "ordinal", "seq", "content", "metadata", "vector")] for r in rows])
    asked = []

    class Database(remote.RelationalSource):
        def rows(self, where, vector, k):
            asked.append((where, k, self.query(where, vector, k)))
            found = con.execute(asked[-1][2]).fetchall()
            return spark.createDataFrame([(*r[:6], json.loads(r[6])) for r in found], remote.ROWS)

    database = Database(spark, "jdbc:none", "t", "-list_inner_product(vector, {v}::FLOAT[16])")
    assert [r.unit_id for r in Engine(spark, store=database, granularity="chunk", embedder=e).search(query).collect()] == want
    if ranked:
        assert asked[-1][1] == 15 and "LIMIT 15" in asked[-1][2]  # three times the limit, as the layout isn't exact
    if ranked is False:
        assert asked[-1][1] is None

    def fetch(condition, vector, k):
        def holds(m, c):
            if "key" in c:
                v = m.get(c["key"])
                return v == c["match"]["value"] if "match" in c else all({"gte": v >= x, "lt": v < x, "lte": v <= x, "gt": v > x}[o] for o, x in c["range"].items())
            return all(holds(m, x) for x in c.get("must", ())) and not any(holds(m, x) for x in c.get("must_not", ())) and ("should" not in c or any(holds(m, x) for x in c["should"]))

        found = [r for r in rows if condition is None or holds(r["metadata"], condition)]
        found.sort(key=lambda r: -float(np.dot(r["vector"], vector)) if vector is not None else r["seq"])
        return found[:k]

    service = remote.ServiceSource(spark, fetch)
    assert [r.unit_id for r in Engine(spark, store=service, granularity="chunk", embedder=e).search(query).collect()] == want


def test_statements_are_closed():
    assert remote.inline("a = %s AND b = %s", ["it's", 3]) == "a = 'it''s' AND b = 3"
    assert [remote.literal(x) for x in (None, True, 1.5)] == ["NULL", "TRUE", "1.5"]
    with pytest.raises(ValueError):
        remote.inline("a = %s", [])
