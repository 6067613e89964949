"""The versioned store: what is current, what is checked, what a reading costs."""

import pytest
from pyspark.sql import functions as F

from quillspan.engine import Engine
from quillspan.errors import ExecutionError, PlanError, SchemaError
from quillspan.operators.embed import HashEmbedder
from quillspan.operators.text import sentences
from quillspan.plans.analyze import PROFILES
from quillspan.sources.files import load_documents
from quillspan.sources.store import Store


def make(spark, path, fields=None, **how):
    how = {"embedder": HashEmbedder(8), "granularity": "sentence"} | how
    return Engine(spark, store=Store(spark, str(path), fields), **how)


def doc(ident, text, **metadata):
    return {"doc_id": ident, "text": text, "metadata": metadata}


def contents(e, query="SELECT SENTENCE"):
    return sorted(r.content for r in e.search(query).collect())


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_of_any_number_of_units(spark, tmp_path):
    """Ordinals and versions are columns of their own: no ordinal runs into another version."""
    e = make(spark, tmp_path)
    e.add_documents([doc("a", "One.")])
    units = e.store.units().drop("seq", "version")
    many = units.crossJoin(spark.createDataFrame([(0,), (999_999,), (1_000_000,), (2_147_483_646,)], "o int")).withColumn("ordinal", F.col("o"))
    store = Store(spark, str(tmp_path / "big"))
    store.append(None, many.withColumn("unit_id", F.concat("doc_id", F.lit("#"), F.col("o").cast("string"))).drop("o"))
    assert sorted(r.ordinal for r in store.units().collect()) == [0, 999_999, 1_000_000, 2_147_483_646]
    assert [r.ordinal for r in store.units().orderBy("seq").collect()] == [0, 999_999, 1_000_000, 2_147_483_646]


def test_last_row_of_a_batch_and_last_version_win(spark, tmp_path):
    e = make(spark, tmp_path)
    e.add_documents([doc("z", "First. Second."), doc("y", "Other."), doc("z", "Last one.")])
    assert contents(e) == ["Last one.", "Other."]
    e.add_documents([doc("z", "Newer. Newest.")])
    e.add_documents([doc("x", "Fresh.")])
    assert contents(e) == ["Fresh.", "Newer.", "Newest.", "Other."]
    assert [m["replaced"] for m in e.store.manifests()] == [0, 1, 0] and e.store.next_seq() == 3
    assert [r.doc_id for r in e.store.documents().orderBy("doc_id").collect()] == ["x", "y", "z"]
    e.add_documents([doc("y", "")])
    assert contents(e) == ["Fresh.", "Newer.", "Newest."] and e.store.document("y").count() == 1


def test_what_was_never_committed_isn_t_there(spark, tmp_path):
    e = make(spark, tmp_path)
    e.add_documents([doc("a", "One.")])
    claimed = e.store._claim()
    e.store.units().drop("seq").write.parquet(f"{e.store.path}/units/{claimed:08d}")
    assert contents(e) == ["One."]
    e.add_documents([doc("b", "Two.")])
    assert contents(e) == ["One.", "Two."] and [m["version"] for m in e.store.manifests()] == [0, 2]
    # two writers never get one version
    assert Store(spark, str(tmp_path))._claim() != Store(spark, str(tmp_path))._claim()


def test_vectors_are_checked_before_the_commit(spark, tmp_path):
    e = make(spark, tmp_path)
    e.add_documents([doc("a", "One.")])
    with pytest.raises(ExecutionError, match="must have 8 numbers"):
        make(spark, tmp_path, embedder=HashEmbedder(4)).add_documents([doc("b", "Two.")])
    with pytest.raises(ExecutionError, match="no vector"):
        units = e.store.units().drop("seq", "version").withColumn("vector", F.lit(None).cast("array<float>"))
        e.store.append(None, units, require_vectors=True)
    mixed = e.store.units().drop("seq", "version")
    with pytest.raises(ExecutionError, match="numbers"):
        e.store.append(None, mixed.unionByName(mixed.withColumn("vector", F.slice("vector", 1, 3))))
    assert contents(e) == ["One."]


def test_declared_fields_reach_the_scan(spark, tmp_path):
    e = make(spark, tmp_path, {"status": "string", "year": "bigint"})
    e.add_documents([doc("a", "One. Two.", status="p", year=2024), doc("b", "Three.", status="d", year="2020"), doc("c", "Four.")])
    found = e.search('SELECT SENTENCE WHERE status == "p" AND meta.year >= 2024 ORDER BY SIMILARITY(content, "one") DESC LIMIT 1')
    assert [r.content for r in found.collect()] == ["One."]
    plan = physical(found)
    pushed = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "m_status" in pushed.split("PushedFilters")[1] and "m_year" in pushed.split("PushedFilters")[1]
    assert "Exchange" not in plan and "Join" not in plan  # nothing was replaced: no shuffle, no join
    assert contents(e, "SELECT SENTENCE WHERE year < 2024") == ["Three."]
    e.add_documents([doc("a", "Five.", status="p", year=2025)])
    again = e.search('SELECT SENTENCE WHERE status == "p"')
    assert [r.content for r in again.collect()] == ["Five."] and "m_status" in physical(again).split("PushedFilters")[1]
    small = e.store.compact(str(tmp_path / "small"))
    assert small.fields == {"status": "string", "year": "bigint"} and small.manifests()[0]["replaced"] == 0
    e2 = Engine(spark, store=small, embedder=HashEmbedder(8), granularity="sentence")
    assert contents(e2) == contents(e)
    e2.add_documents([doc("a", "Six.")])
    assert contents(e2) == ["Four.", "Six.", "Three."]
    with pytest.raises(SchemaError):
        Store(spark, str(tmp_path), {"status": "bigint"})


def test_ingestion_keeps_texts_in_their_rows(spark, tmp_path):
    """Splitting and numbering shuffle nothing; ordinals run through the payloads."""
    e = make(spark, tmp_path, embedder=None)
    rows = [{"doc_id": "a", "payloads": [{"modality": "text", "text": "Eins.  Zwei."}, {"modality": "image", "uri": "u:x"}, {"modality": "text", "text": "cafe\u0301. Vier."}]}]
    docs, units = e.pipeline.run(e.pipeline.frame(spark, rows))
    assert "Exchange" not in physical(units)
    assert [(r.ordinal, r.content) for r in units.orderBy("ordinal").collect()] == [(0, "Eins."), (1, "Zwei."), (2, ""), (3, "caf\u00e9."), (4, "Vier.")]


def test_custom_splitters_and_normalisers(spark, tmp_path):
    e = make(spark, tmp_path / "a", embedder=None, normalizer=F.upper)
    e.register_splitter("SENTENCE", python=lambda t: t.split("; "), overwrite=True)
    e.add_documents([doc("a", "aa; bb; cc")])
    assert contents(e) == ["AA", "BB", "CC"]
    routed = make(spark, tmp_path / "b", embedder=None, script_splitters={"default": sentences, "cjk": lambda t: F.split(t, "\u3001", -1)})
    routed.add_documents([doc("a", "One. Two."), doc("b", "\u4e00\u3001\u4e8c")])
    assert contents(routed) == ["One.", "Two.", "\u4e00", "\u4e8c"]
    with pytest.raises(PlanError, match="normaliser"):
        make(spark, tmp_path / "c", embedder=None, normalizer=F.udf(lambda t: t)).add_documents([doc("a", "x")])


def test_spans_use_the_registered_splitter(spark):
    from quillspan.sources.collection import of_table

    c = of_table(spark.createDataFrame([(1, "aa; bb; cc")], "id long, t string"), "id", "t")
    e = Engine(spark, c)
    e.register_splitter("SENTENCE", build=lambda t: F.split(t, "; ", -1), overwrite=True)
    assert sorted(r.content for r in e.search("SELECT SPAN(SENTENCE, 1)").collect()) == ["aa bb", "aa bb cc", "bb cc"]


def test_ingestion_looks_vectors_up(spark, tmp_path):
    # a class of the function goes to the workers by value
    class Counting(HashEmbedder):
        """Leaves a file for every text it embeds."""

        def __init__(self, dim, folder):
            super().__init__(dim)
            self.folder = folder

        def embed(self, texts):
            import os
            import uuid

            for t in texts:
                open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
            return super().embed(texts)

    calls = tmp_path / "calls"
    calls.mkdir()
    e = make(spark, tmp_path / "s", embedder=Counting(8, str(calls)), embedding_cache=str(tmp_path / "cache"))
    e.add_documents([doc("a", "One. Two. One.")])
    assert len(list(calls.iterdir())) == 2
    e.add_documents([doc("b", "Two. Three.")])
    assert len(list(calls.iterdir())) == 3
    plain = make(spark, tmp_path / "t")
    plain.add_documents([doc("a", "One. Two. One."), doc("b", "Two. Three.")])
    vectors = lambda x: {(r.unit_id, tuple(r.vector)) for r in x.store.units().collect()}
    assert vectors(e) == vectors(plain)


def test_approximate_recall(spark, tmp_path):
    docs = [doc(f"d{i}", f"word{i % 40} term{i % 7} and word{(i * 7) % 40}.", odd=i % 2) for i in range(300)]
    e = make(spark, tmp_path)
    e.add_documents(docs)
    index = e.store.build_cells(cells=8, probes=3)
    near = Engine(spark, store=e.store, embedder=HashEmbedder(8), granularity="sentence", profile=PROFILES["hnsw"])
    q = 'SELECT SENTENCE LET r = SIMILARITY(content, "word3 term3.") ORDER BY r DESC LIMIT 10'
    assert near.explain(q)["recall"] == "approximate-top-k" and e.explain(q)["recall"] == "exact-top-k"
    found = near.search(q)
    assert "PartitionFilters: [cell" in physical(found).replace("isnotnull(cell#", "cell#") or "cell" in physical(found)
    want = [r.unit_id for r in e.search(q).collect()]
    assert len(set(want) & {r.unit_id for r in found.collect()}) >= 8
    # a filter that the nearest cells can't fill reads on
    rare = 'SELECT SENTENCE LET r = SIMILARITY(content, "word3 term3.") WHERE meta.odd == 1 ORDER BY r DESC LIMIT 100'
    assert [r.unit_id for r in near.search(rare).collect()] == [r.unit_id for r in e.search(rare).collect()]
    # an order of its own needs all units
    assert near.explain("SELECT SENTENCE LET r = SIMILARITY(content, 'x') ORDER BY LENGTH(content) LIMIT 3".replace("'", '"'))["recall"] != "approximate-top-k"
    # what is added later is searched too, what is replaced makes the search exact
    near.add_documents([doc("new", "word3 term3.")])
    assert near.search(q).first().doc_id == "new"
    near.add_documents([doc("new", "gone.")])
    assert near.explain(q)["recall"] == "exact-top-k" and near.search(q).first().doc_id != "new"
    assert index.probes == 3


def test_files_keep_the_types_of_given_metadata(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One.")
    e = make(spark, tmp_path / "s", embedder=None)
    assert e.add_file(str(tmp_path / "a.txt"), metadata={"done": True, "n": 3, "tags": ["x"], "note": "7"}) == ["a"]
    assert contents(e, "SELECT SENTENCE WHERE meta.done == true AND meta.n < 4 AND meta.done == 1 AND meta.source") == ["One."]
    assert load_documents(spark, str(tmp_path / "a.txt"), metadata={"done": False}).selectExpr("variant_get(metadata, '$.done', 'boolean') as d").first().d is False


@pytest.mark.parametrize(
    ("where", "found"),
    [
        ("meta.done == 1", ["a"]), ("meta.done == 0", ["b"]), ("meta.done == true", ["a"]), ("meta.done != 1", ["b", "c", "d"]), ("meta.n == true", ["a"]), ("meta.done > 0", ["a"]),
        ("meta.done >= false", ["a", "b"]), ("meta.done < 0.5", ["b"]), ("meta.done", ["a", "d"]), ("NOT meta.done", ["b", "c"]), ("meta.n", ["a", "d"]),
        ("meta.done == \"True\"", []), ("meta.n == \"1\"", ["a"]),
    ],
)
def test_booleans_of_open_metadata_are_numbers(spark, where, found):
    from quillspan.sources.collection import Collection

    rows = [("a", '{"done": true, "n": 1}'), ("b", '{"done": false, "n": 0}'), ("c", "{}"), ("d", '{"done": "yes", "n": 2}')]
    units = spark.createDataFrame([(i, i, 0, k, "x", j) for k, (i, j) in enumerate(rows)], "unit_id string, doc_id string, ordinal int, seq long, content string, j string").withColumn("m", F.parse_json("j")).drop("j")
    e = Engine(spark, Collection(units, "sentence", {}, "m"), strict=False)
    assert sorted(r.unit_id for r in e.search(f"SELECT SENTENCE WHERE {where}").collect()) == found
