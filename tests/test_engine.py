"""End to end: recall, granularity, writing, extension points."""

import functools
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.engine import Engine as _Engine
from quillspan.errors import EmbeddingError, PlanError, RegistryError, SchemaError
from quillspan.functions.registry import Registry, Signature
from quillspan.operators import metrics, vectors
from quillspan.operators.embed import HashEmbedder, HttpEmbedder, MultimodalHttpEmbedder, cache_key, driver_key, embed_cached, embed_column, image_uri, unit_rows, unit_vector
from quillspan.operators.rerank import TokenOverlap, overlap
from quillspan.plans import catalogue
from quillspan.plans.plan import neighbours
from quillspan.sources.collection import PROFILES, Collection, of_table, split_units, upsert
from quillspan.sources.store import Store
from quillspan.sources.files import docx_text, load_documents, loader_for, register_loader
from quillspan.streaming.ingest import ingest_stream

Engine = functools.partial(_Engine, insertion_order=True)  # rows without an order of their own are compared as they were added


DOCS = [
    {"doc_id": "a", "text": "Agents plan tasks. Agents call tools. The sea is calm.", "metadata": {"status": "published", "year": 2024, "n": {"deep": [1, 2]}}},
    {"doc_id": "b", "text": "Bread needs rye. Dough rests overnight.", "metadata": {"status": "draft", "year": "2023"}},
    {"doc_id": "c", "text": "Harbours freeze. Agents rest.", "metadata": {"status": "published"}},
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    Engine(spark, store=s, embedder=HashEmbedder(32), granularity="sentence").add_documents(DOCS)
    return s


@pytest.fixture(scope="module")
def engine(spark, store):
    return Engine(spark, store=store, embedder=HashEmbedder(32), granularity="sentence")


def texts(df):
    return [r.content for r in df.collect()]


def test_semantic_order(engine):
    rows = engine.search('SELECT SENTENCE LET rel = SIMILARITY(content, "agents call tools.") ORDER BY rel DESC LIMIT 2').collect()
    assert rows[0].content == "Agents call tools." and abs(rows[0].rel - 1) < 1e-5 and rows[0].unit_id == "a#sentence:1"
    default = engine.search('SELECT SENTENCE LET rel = SIMILARITY(content, "agents call tools.") LIMIT 1').collect()
    assert default[0].unit_id == "a#sentence:1"


def test_metadata_and_keyword(engine):
    assert texts(engine.search('SELECT SENTENCE WHERE meta.status == "published" AND content CONTAINS "agents"')) == ["Agents plan tasks.", "Agents call tools.", "Agents rest."]
    assert texts(engine.search("SELECT SENTENCE WHERE meta.year >= 2024"))[0] == "Agents plan tasks."
    assert len(texts(engine.search("SELECT SENTENCE WHERE NOT meta.year >= 2024"))) == 4
    assert len(engine) == 7


def test_span(engine):
    r = engine.search('SELECT SPAN(SENTENCE, 1) WHERE content CONTAINS "call tools"').first()
    assert (r.unit_id, r.content, r.span_start, r.span_end, r.kind) == ("a#span:1~1", "Agents plan tasks. Agents call tools. The sea is calm.", 0, 2, "span")
    limited = engine.search('SELECT SPAN(SENTENCE, 1) WHERE content CONTAINS "call tools" LIMIT 5').first()
    assert limited.content == r.content
    assert texts(engine.search('SELECT SPAN(SENTENCE, 0) WHERE content CONTAINS "rye"')) == ["Bread needs rye."]


def test_documents_and_chunks(engine):
    rows = engine.search('SELECT DOCUMENT LET n = LENGTH(content) WHERE content CONTAINS "agents" ORDER BY n DESC LIMIT 2').collect()
    assert [r.doc_id for r in rows] == ["a", "c"] and rows[0].content == DOCS[0]["text"] and rows[0].n == 18
    chunk = engine.search('SELECT CHUNK WHERE content CONTAINS "agents" ORDER BY content DESC').collect()
    assert sorted((r.unit_id, r.content) for r in chunk) == [("a#chunk", "Agents plan tasks. Agents call tools."), ("c#chunk", "Agents rest.")]
    with pytest.raises(PlanError):
        engine.search("SELECT SPAN(DOCUMENT)")
    with pytest.raises(PlanError):
        engine.search("SELECT SPAN(CHUNK)")


def test_sentences_from_documents(spark):
    df = spark.createDataFrame([(1, "One. Two! Three?"), (2, None), (3, "")], "id long, text string")
    c = of_table(df, "id", "text")
    assert texts(Engine(spark, c).search("SELECT SENTENCE")) == ["One.", "Two!", "Three?"]
    spans = Engine(spark, c).search('SELECT SPAN(SENTENCE, 1) WHERE content CONTAINS "two"').collect()
    assert [r.content for r in spans] == ["One. Two!", "One. Two! Three?", "Two! Three?"]
    with pytest.raises(PlanError):
        Engine(spark, c).search("SELECT CHUNK")


def test_custom_granularity(spark):
    df = spark.createDataFrame([(1, "a\n\nb")], "id long, text string")
    c = split_units(of_table(df, "id", "text"), "paragraph", lambda t: F.split(t, "\n\n", -1))
    assert texts(Engine(spark, c).search("SELECT CHUNK")) == ["a", "b"]
    assert texts(Engine(spark, c).search("SELECT DOCUMENT")) == ["a\n\nb"]
    with pytest.raises(PlanError):
        Engine(spark, c).search("SELECT SENTENCE")


def test_front_doors(engine):
    text = 'SELECT SENTENCE WHERE content CONTAINS "rye" LIMIT 9'
    q = engine.query(text)
    assert texts(engine.search(text)) == texts(engine.search(q)) == texts(engine.search_ir(q.to_dict())) == ["Bread needs rye."]
    assert texts(engine.search("SELECT SENTENCE LIMIT 3", limit=1)) == ["Agents plan tasks."] and q.limit == 9
    assert "SIMILARITY" in engine.schema()["$defs"]["call"]["properties"]["name"]["enum"]


def test_explain(engine):
    x = engine.explain('SELECT SENTENCE LET r = SIMILARITY(content, "q") WHERE meta.status == "p" AND r > 0 LIMIT 4', physical=True)
    assert x["recall"] == "exact-top-k" and x["filter"]["pushed"]["op"] == "==" and x["filter"]["residual"]["op"] == ">"
    assert x["scores"] == [{"alias": "r", "query": "q", "vector": "default"}] and "TakeOrderedAndProject" in x["physical"]
    assert engine.explain("SELECT SENTENCE")["recall"] == "scan"


def test_layouts_agree(spark, engine):
    base = engine.collection
    want = texts(engine.search('SELECT SENTENCE WHERE meta.status == "published" AND SIMILARITY(content, "agents rest.") > 0.2'))
    for p in PROFILES.values():
        c = Collection(base.units, base.granularity, base.fields, base.open_metadata, base.vectors, base.documents, p)
        assert texts(Engine(spark, c, embedder=HashEmbedder(32)).search('SELECT SENTENCE WHERE meta.status == "published" AND SIMILARITY(content, "agents rest.") > 0.2')) == want


def test_adding_again_replaces_all_units(spark, tmp_path):
    e = Engine(spark, store=Store(spark, str(tmp_path)), embedder=HashEmbedder(8), granularity="sentence")
    e.add_text("One. Two. Three.", doc_id="x")
    e.add_text("Only one.", {"k": "v"}, doc_id="x")
    assert texts(e.search("SELECT SENTENCE")) == ["Only one."]
    assert e.store.document("x").count() == 1 and e.store.next_seq() == 2
    assert e.store.compact(str(tmp_path) + "-c").count() == 1
    auto = e.add_text("Named by the engine.")
    assert auto in [r.doc_id for r in e.search("SELECT DOCUMENT").collect()]
    assert [r.ordinal for r in e.store.neighbours("x", 0, 1).collect()] == [0]
    with pytest.raises(SchemaError):
        e.add_documents([{"doc_id": "y"}])
    with pytest.raises(SchemaError):
        e.add_documents([{"doc_id": "y", "payloads": [{"modality": "text", "text": 3}]}])


def test_images_and_named_vectors(spark, tmp_path):
    e = Engine(spark, store=Store(spark, str(tmp_path / "s")), embedder=HashEmbedder(16), named_embedders={"title": HashEmbedder(8)}, granularity="chunk")
    (tmp_path / "cat.png").write_bytes(b"a red cat")
    e.add_image(str(tmp_path / "cat.png"), {"t": 1}, doc_id="cat")
    e.add_image("https://example.org/dog.png", doc_id="dog")
    e.add_multivector("m1", "body words", {"title": "blue whale", "image": b"a green bird"}, {"k": 2})
    rows = e.search('SELECT CHUNK LET r = SIMILARITY(content, "a red cat") LIMIT 1').collect()
    assert rows[0].doc_id == "cat" and rows[0].content == "" and rows[0].r > 0.99
    named = e.search('SELECT CHUNK LET t = SIMILARITY(vec.title, "blue whale") ORDER BY t DESC').collect()
    assert named[0].unit_id == "m1" and named[0].t > 0.99 and named[1].t == -2.0


def test_vector_errors(spark):
    c = of_table(spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<float>"), "id", F.lit("x"), [], {"default": "v"})
    with pytest.raises(Exception, match="query vector"):
        Engine(spark, c).search('SELECT DOCUMENT LET r = SIMILARITY(content, "q")', vectors={"q": [1.0]}).collect()
    with pytest.raises(PlanError):
        Engine(spark, c).search('SELECT DOCUMENT LET r = SIMILARITY(content, "q")')
    with pytest.raises(PlanError):
        Engine(spark, of_table(spark.range(1), "id", F.lit("x"))).search('SELECT DOCUMENT LET r = SIMILARITY(content, "q")', vectors={"q": [1.0]})


def test_top_k_layouts(spark):
    rng = np.random.default_rng(0)
    m = unit_rows(rng.standard_normal((300, 8)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<float>")
    q = m[5].astype(float)
    want = list(np.argsort(-(m.astype(float) @ q), kind="stable")[:7])
    assert [r.id for r in vectors.top_k(df, "v", list(q), 7, ["id"]).collect()] == want
    assert [r.id for r in df.withColumn("s", vectors.arrow_dot(F.col("v"), q)).orderBy(F.desc("s"), "id").limit(7).collect()] == want
    qs = df.where("id < 5").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    got = vectors.batch_top_k(df, "id", "v", qs, 4, block=2).collect()
    for i in range(5):
        assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == list(np.argsort(-(m.astype(float) @ m[i].astype(float)), kind="stable")[:4])
    assert vectors.batch_top_k(df, "id", "v", qs.limit(0), 4).count() == 0


def test_cell_index(spark, tmp_path):
    rng = np.random.default_rng(1)
    m = unit_rows(np.repeat(rng.standard_normal((8, 16)), 40, 0) + 0.2 * rng.standard_normal((320, 16)))
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(m)], "id long, v array<float>, odd int")
    index = vectors.CellIndex.build(df, "v", str(tmp_path / "i"), cells=8)
    recall = 0
    for q in range(0, 320, 40):
        want = set(np.argsort(-(m @ m[q]))[:10])
        recall += len(want & {r.id for r in index.search(spark, m[q].tolist(), 10, probes=2, tie=("id",)).collect()})
    assert recall >= 72
    assert index.search(spark, m[0].tolist(), 10, probes=1, condition=F.col("odd") == 1).count() == 10


def test_rerank(spark, engine):
    df = spark.createDataFrame([("the agent rests",), ("Agent TOOLS agent",), (None,)], "content string")
    assert [r[0] for r in df.select(overlap("agent tools", F.col("content"))).collect()] == [0.5, 1.0, 0.0]
    e = Engine(spark, engine.collection, embedder=HashEmbedder(32), reranker=TokenOverlap(), rerank_factor=10)
    rows = e.search('SELECT SENTENCE LET r = SIMILARITY(content, "sea") LIMIT 1', rerank_query="rye bread").collect()
    assert rows[0].content == "Bread needs rye."
    assert e.explain('SELECT SENTENCE LET r = SIMILARITY(content, "sea")')["rerank"]["factor"] == 10


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "query_id int, id string, rank int")
    gold = spark.createDataFrame([(1, "b"), (1, "z"), (2, "y")], "query_id int, id string")
    got = {r.query_id: (r.hit_rate, r.recall_at_k, r.reciprocal_rank) for r in metrics.per_query(ranked, gold, 1).collect()}
    assert got == {1: (0.5, 0.0, 0.5), 2: (0.0, 0.0, 0.0)}
    assert metrics.summary(ranked, gold).first().mrr == 0.25
    corpus = spark.createDataFrame([(i, "t" if i < 3 else str(i)) for i in range(9)], "id int, text string")
    assert metrics.dedup_by_text(corpus).count() == 7
    assert metrics.distractors(corpus, corpus.where("id < 4"), 3).count() == 3


def test_hash_embedder(spark):
    e = HashEmbedder(16)
    assert np.allclose(np.linalg.norm(e.embed(["x y", "", "x y"]), axis=1), 1) and e.embed([]).shape == (0, 16)
    df = spark.createDataFrame([("Rye bread",), ("",), (None,)], "t string").select(embed_column(F.col("t"), e).alias("v"))
    assert np.allclose([r.v for r in df.collect()], e.embed(["Rye bread", "", ""]))
    z = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>").select(unit_vector(F.col("v")).alias("v")).collect()
    assert [list(map(float, r.v)) for r in z] == [[0.0, 0.0], pytest.approx([0.6, 0.8])]


def test_embedding_cache(spark, tmp_path):
    e, path = HashEmbedder(8), str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "i int, t string")
    first = embed_cached(df, "t", e, path).orderBy("i").collect()
    assert spark.read.parquet(path).count() == 3 and first[0].vector == first[2].vector
    embed_cached(df.union(df.limit(1)), "t", e, path)
    assert spark.read.parquet(path).count() == 3
    assert df.select(cache_key(F.col("t"), e)).first()[0] == driver_key("a", e)


def test_http_embedders():
    calls = []

    def post(path, body):
        calls.append((path, body))
        n = len(body["input"])
        return {"data": [{"index": i, "embedding": [0.0, i + 1.0]} for i in reversed(range(n))]}

    e = HttpEmbedder("m", 2, post, batch=2)
    assert np.allclose(e.embed(["a", "b", "c"]), [[0, 1]] * 3) and len(calls) == 2 and calls[0][1]["dimensions"] == 2
    with pytest.raises(EmbeddingError):
        HttpEmbedder("m", 2, lambda p, b: {"data": []}).embed(["a"])
    m = MultimodalHttpEmbedder("m", 2, lambda p, b: {"data": {"embedding": [3.0, 4.0]}})
    assert np.allclose(m.embed_images([b"\x89PNG.."]), [[0.6, 0.8]])
    assert image_uri(b"\xff\xd8x").startswith("data:image/jpeg") and image_uri("http://x") == "http://x"


def test_loaders(spark, tmp_path):
    (tmp_path / "n.md").write_text("# Title\nbody", encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "w.docx", "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>One </w:t><w:t>line</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>")
    assert docx_text((tmp_path / "w.docx").read_bytes()) == "One line\nTwo"
    md = load_documents(spark, str(tmp_path / "n.md"), metadata={"k": "v"}).selectExpr("doc_id", "payloads[0].text as t", "try_variant_get(metadata, '$.k', 'string') as k").first()
    assert (md.doc_id, md.t, md.k) == ("n", "# Title\nbody", "v")
    assert load_documents(spark, str(tmp_path / "w.docx")).select("payloads.text").first()[0] == ["One line\nTwo"]
    with pytest.raises(RegistryError):
        loader_for("x.unknown")
    register_loader("up", lambda s, p: load_documents.__globals__["text_files"](s, p), ".up")
    (tmp_path / "u.up").write_text("hi")
    e = Engine(spark, store=Store(spark, str(tmp_path / "s")), granularity="document")
    assert e.add_files([str(tmp_path / "u.up"), str(tmp_path / "n.md")]) == ["u", "n"]
    assert sorted(texts(e.search("SELECT DOCUMENT"))) == ["# Title\nbody", "hi"]


def test_stream_ingestion(spark, tmp_path):
    e = Engine(spark, store=Store(spark, str(tmp_path / "s")), embedder=HashEmbedder(8), granularity="sentence")
    e.pipeline.frame(spark, DOCS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    ingest_stream(e, stream, str(tmp_path / "cp")).awaitTermination()
    assert len(e) == 7


def test_registry_scopes():
    top = Registry()
    top.function("F", Signature(("text",)), build=lambda x: x)
    child = top.child()
    child.function("f", Signature(()), build=lambda: 1)
    assert child.get("function", "F").signature.args == () and top.get("function", "f").signature.args == ("text",)
    assert child.names("function") == ["F"]
    with pytest.raises(RegistryError):
        top.function("f", build=lambda x: x)
    top.function("f", build=lambda x: x, overwrite=True)
    with pytest.raises(RegistryError):
        top.require("splitter", "none")


def test_upsert(spark):
    a = spark.createDataFrame([("x", 1, "old"), ("y", 1, "keep")], "k string, seq int, v string")
    b = spark.createDataFrame([("x", 2, "new"), ("z", 2, None)], "k string, seq int, v string")
    assert sorted(tuple(r) for r in upsert(a, b, "k", "seq").select("k", "v").collect()) == [("x", "new"), ("y", "keep"), ("z", None)]


def test_neighbours_need_a_centre(spark):
    u = spark.createDataFrame([(d, i, f"{d}{i}") for d, n in (("a", 140), ("b", 5), ("c", 7)) for i in range(n)], "doc_id string, ordinal int, content string")
    hits = u.where("ordinal in (5, 63, 64)").select("doc_id", "ordinal")
    got = sorted(tuple(r) for r in neighbours(hits, u, 2).collect())
    want = [("a", c, i, f"a{i}") for c in (5, 63, 64) for i in range(c - 2, c + 3)] + [("c", 5, i, f"c{i}") for i in (3, 4, 5, 6)]
    assert got == want  # b has the sentences 3 and 4, but no centre


def test_neighbour_range_covers_all_documents(spark, data):
    q = catalogue.queries()["neighbour_range"](spark, data)
    assert q.where("cast(doc_id as bigint) % 20 != 0").count() > 0
    assert q.groupBy("doc_id", "centre").agg(F.max((F.col("ordinal") == F.col("centre")).cast("int")).alias("there")).where("there = 0").count() == 0


def test_cell_index_search_of_a_set_is_exact(spark, tmp_path):
    rng = np.random.default_rng(2)
    m = unit_rows(np.concatenate([rng.standard_normal((200, 16)), np.repeat(rng.standard_normal((4, 16)), 40, 0) + 0.01 * rng.standard_normal((160, 16))]))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<float>")
    index = vectors.CellIndex.build(df, "v", str(tmp_path / "i"), cells=8)
    qs = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    want = {(r.query_id, r.id, r["rank"]) for r in vectors.batch_top_k(df, "id", "v", qs, 10).collect()}
    for probes in (1, 3):
        assert {(r.query_id, r.id, r["rank"]) for r in index.batch_search(spark, "id", qs, 10, probes=probes).collect()} == want
    assert {(r.query_id, r.id, r["rank"]) for r in vectors.CellIndex(index.path, index.centres, "v").batch_search(spark, "id", qs, 10, probes=1).collect()} == want
    assert index.batch_search(spark, "id", qs.limit(0), 10).count() == 0
    assert index.search(spark, m[0].tolist(), 300, probes=1).count() == 300


def test_cell_index_topk_recall(spark, data):
    got = {(r.query_id, r.vec_id) for r in catalogue.queries()["cell_index_topk"](spark, data).collect()}
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    qs = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = {(r.query_id, r.vec_id) for r in vectors.batch_top_k(e, "vec_id", "embedding", qs, 10).collect()}
    assert len(want) == 10 * qs.count() and len(got & want) >= 0.9 * len(want)


def test_limit_counts_sentences_not_units(spark):
    texts_ = [None, "", " \n ", "One. Two.", None, "Three is longer. Four.", "   "]
    for n in ("document", "chunk"):
        c = of_table(spark.createDataFrame(list(enumerate(texts_)), "id long, t string"), "id", "t", granularity=n)
        e = Engine(spark, c)
        assert texts(e.search("SELECT SENTENCE LIMIT 3")) == ["One.", "Two.", "Three is longer."]
        assert texts(e.search("SELECT SENTENCE ORDER BY LENGTH(content) LIMIT 3")) == ["One.", "Two.", "Three is longer."]
        assert texts(e.search("SELECT SENTENCE ORDER BY LENGTH(content) DESC LIMIT 3")) == ["Three is longer.", "Four.", "One."]
        assert e.search("SELECT SENTENCE LIMIT 10").count() == 4
    own = Registry()
    own.splitter("SENTENCE", build=lambda t: F.filter(F.split(t, " "), lambda x: x.startswith("F")))
    assert texts(Engine(spark, c, registry=own).search("SELECT SENTENCE LIMIT 1")) == ["Four."]
