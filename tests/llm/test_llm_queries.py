"""Training-text operators on DataFrames: whole tables, edges and clashing columns."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import bytebpe, confusables, langmix, leaks, nearest, queries, sentences, spampages, splitting

STORE = "doc_key string, seq long, payloads array<struct<modality:string,data:string,mime:string>>, metadata map<string,string>, source string, profile string, text string, ordinal int"
EN = "The harbour guide reads the old map because the ferry is late. Nobody waits for the second boat."
DE = "Die müde Bäckerin liest den alten Ordner, denn die Fähre kommt nicht. Niemand wartet auf das zweite Boot."


def store(spark, rows):
    full = [(k, s, p if p is None else [(m, d, None) for m, d in p], m2, None, prof, "x", 1) for k, s, p, m2, prof in rows]
    return spark.createDataFrame(full, STORE)


@pytest.fixture(scope="module")
def samples(spark, data):
    return spark.read.parquet(f"{data}/lang_samples.parquet")


@pytest.fixture(scope="module")
def edge_docs(spark):
    rows = [
        ("old", 1, [("text", "First version.")], {"lang": "en"}, None),
        ("old", 2, [("text", EN)], {"lang": "en"}, None),
        ("old", 2, [("text", EN)], {"lang": "en"}, None),
        ("mixed", 1, [("image", "file:x"), ("text", EN + "\n" + DE), ("text", DE)], {"lang": "en"}, "default"),
        ("wrong", 1, [("text", DE)], {"lang": "fr-CA"}, None),
        ("none", 1, [("text", EN)], None, "no such profile"),
        ("logs", 1, [("text", "12:00:01 a=1 b=2\n0x12 0x34")], {"lang": "en"}, None),
        ("empty", 1, [("text", ""), ("text", None)], {}, None),
        ("bare", 1, None, None, None),
        ("nothing", 1, [], None, None),
        ("long", 1, [("text", EN * 30), ("text", "x" * 2500)], {"lang": "eng"}, None),
        (None, 1, [("text", EN)], None, None),
    ]
    return store(spark, rows)


def test_languages(spark, edge_docs, samples):
    got = sorted(tuple(r) for r in langmix.wrongly_labelled(edge_docs, samples).collect())
    assert got == [("mixed", 0, "en"), ("mixed", 1, "de"), ("none", 0, "en"), ("wrong", 0, "de")]
    segs = {r.doc_key: r for r in langmix.language_segments(edge_docs, samples).collect()}
    assert "logs" not in segs and "empty" not in segs and segs["old"].confidence > 0.9
    docs = {r.doc_key: r for r in langmix.document_languages(edge_docs, samples).collect()}
    assert docs["mixed"].lang == "de" and docs["mixed"].langs == ["de", "en"]
    assert langmix.wrongly_labelled(edge_docs.limit(0), samples).count() == 0
    assert langmix.wrongly_labelled(edge_docs, samples.limit(0)).count() == 0


def test_held_out_language_accuracy(spark, data):
    con = duckdb.connect()
    rows = con.execute(f"SELECT lang, text FROM '{data}/lang_samples.parquet' ORDER BY sample_id").fetchall()
    model = langmix.Model([r for i, r in enumerate(rows) if i % 4])
    test = [r for i, r in enumerate(rows) if i % 4 == 0]
    ll, ok = model.scores([t for _, t in test])
    right = sum(model.langs[k] == lang for k, (lang, _) in zip(ll.argmax(1), test))
    assert ok.all() and right / len(test) > 0.97


def test_sentence_units(spark, edge_docs):
    rows = sentences.split_sentences(edge_docs).where("doc_key = 'mixed'").orderBy("payload_no", "ordinal").collect()
    assert [(r.payload_no, r.ordinal) for r in rows] == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]
    assert rows[0].sentence == EN.split(". ")[0] + "."
    ends = {tuple(r) for r in sentences.sentence_ends(edge_docs).collect()}
    assert ends == {(r.doc_key, r.payload_no, r.end_pos) for r in sentences.split_sentences(edge_docs).collect()}
    assert {k for k, *_ in ends} == {"old", "mixed", "wrong", "none", "logs", "long"}
    assert sentences.sentence_ends(edge_docs.limit(0)).count() == 0


def test_splitting(spark, edge_docs, data):
    profiles = spark.read.parquet(f"{data}/split_profiles.parquet")
    got = sorted(tuple(r) for r in splitting.oversized_payloads(edge_docs, profiles).collect())
    assert got == [("long", 0, 0), ("long", 1, 1)]
    units = splitting.split_units(edge_docs, profiles).where("doc_key = 'long'").orderBy("ordinal").collect()
    assert [u.ordinal for u in units] == list(range(len(units))) and max(len(u.data) for u in units) <= 1000
    assert splitting.split_units(edge_docs, profiles.limit(0)).where("doc_key = 'none'").count() == 1
    assert splitting.oversized_payloads(edge_docs.limit(0), profiles).count() == 0


def test_blank_payloads_over_the_limit_count(spark, data):
    profiles = spark.read.parquet(f"{data}/split_profiles.parquet")
    docs = store(spark, [("blank", 1, [("text", " \n" * 2500), ("text", "   "), ("text", EN * 30)], None, None), ("lines", 1, [("text", "\n" * 5001)], None, None)])
    assert sorted(tuple(r) for r in splitting.oversized_payloads(docs, profiles).collect()) == [("blank", 0, 0), ("blank", 2, 0), ("lines", 0, 0)]
    units = splitting.split_units(docs, profiles).orderBy("ordinal").collect()
    assert {u.doc_key for u in units} == {"blank"} and [u.ordinal for u in units] == list(range(len(units)))


def test_splitting_against_sql(spark, data):
    con = duckdb.connect()
    for t in ("store_docs", "split_profiles"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    covered = con.execute(queries.oracle_sql()["p3_coverage"]).fetchall()
    assert sorted(covered) == sorted(tuple(r) for r in queries.queries()["p3_coverage"](spark, data).collect()) and covered
    want = sorted(con.execute(queries.oracle_sql()["p3_found"]).fetchall())
    got = sorted(tuple(r) for r in queries.queries()["p3_found"](spark, data).select("doc_key", "payload_no", "forced").collect())
    cols = [c[0] for c in con.execute(queries.oracle_sql()["p3_found"]).description]
    assert cols == ["doc_key", "payload_no", "forced"] and got == want and got


def test_lookalikes_against_brute_force(spark, data):
    rows = [(1, "abc"), (1, "abc"), (2, "аbc"), (3, "a​bc"), (4, "abc"), (5, "ABC"), (6, None), (7, ""), (8, " ​"), (9, " "), (None, "аbc"), (10, "a b"), (10, "a b")]
    df = spark.createDataFrame([(i, "text", d, "k") for i, d in rows], "payload_id long, modality string, data string, k string")
    got = sorted(tuple(r) for r in confusables.lookalike_pairs(df).collect())
    assert got == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]
    assert confusables.lookalike_pairs(df.limit(0)).count() == 0
    real = spark.read.parquet(f"{data}/payloads.parquet")
    pairs = {tuple(r) for r in confusables.lookalike_pairs(real).collect()}
    by = {}
    for r in real.where("modality = 'text' and data is not null").select("payload_id", "data").distinct().collect():
        s = confusables.skeleton(r.data)
        if s.strip():
            by.setdefault(s, []).append((r.payload_id, r.data))
    want = {(min(a, b), max(a, b)) for v in by.values() for a, x in v for b, y in v if x != y and a != b}
    assert pairs == want and want
    seen = {(r.payload_id, r.look) for r in confusables.lookalike_classes(real).collect()}
    members = {i for p in pairs for i in p}
    assert members <= {i for i, _ in seen} and len({look for _, look in seen}) == sum(len({d for _, d in v}) > 1 for v in by.values())


def test_a_wrong_splitter_shows(spark, data, monkeypatch):
    docs, profiles = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("store_docs", "split_profiles"))
    units = splitting.split_units(docs, profiles)
    monkeypatch.setattr(splitting, "split_units", lambda *a, **k: units.withColumn("end_pos", F.col("start_pos") + F.col("max_chars") + 1))
    with pytest.raises(Exception, match="over its limit"):
        splitting.oversized_payloads(docs, profiles).collect()
    assert splitting.coverage(docs, profiles).where("not within").count() > 0


def brute_pairs(x, ids, k, least):
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    out = set()
    for i in range(len(x)):
        out |= {tuple(sorted((ids[i], ids[j]))) for j in np.argsort(-sim[i], kind="stable")[:k] if sim[i, j] >= least}
    return out


def test_nearest_against_brute_force(spark, data):
    got = {tuple(r) for r in queries.queries()["p5_found"](spark, data).collect()}
    rows = duckdb.connect().execute(f"SELECT unit_id, arg_max(vector, seq) FROM '{data}/units.parquet' GROUP BY 1").fetchall()
    rows = [(u, v) for u, v in rows if v is not None and len(v) == 64 and any(v)]
    x = np.array([v for _, v in rows])
    want = brute_pairs(x / np.linalg.norm(x, axis=1, keepdims=True), [u for u, _ in rows], 5, 0.85)
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.95


@pytest.fixture(scope="module")
def larger(spark, data):
    where = data.replace("sf0.001", "sf0.1")
    rows = duckdb.connect().execute(f"SELECT unit_id, arg_max(vector, seq) FROM '{where}/units.parquet' GROUP BY 1").fetchall()
    rows = [(u, v) for u, v in rows if v is not None and len(v) == 64 and any(v)]
    x = np.array([v for _, v in rows], np.float32)
    return spark.read.parquet(f"{where}/units.parquet"), brute_pairs_in_blocks(x / np.linalg.norm(x, axis=1, keepdims=True), [u for u, _ in rows], 5, 0.85)


def brute_pairs_in_blocks(x, ids, k, least):
    out = set()
    for s in range(0, len(x), 2000):
        sim = x[s : s + 2000] @ x.T
        sim[np.arange(len(sim)), s + np.arange(len(sim))] = -2
        top = np.argpartition(-sim, k, 1)[:, :k]
        a, b = np.nonzero(np.take_along_axis(sim, top, 1) >= least)
        out |= {tuple(sorted((ids[s + i], ids[top[i, j]]))) for i, j in zip(a, b)}
    return out


@pytest.mark.parametrize("how", [{}, {"cell": 6}, {"cell": 10**9}, {"exact": True}])
def test_nearest_recall_at_any_number_of_anchors(spark, larger, how):
    """From one cell to more than 4,096 anchors."""
    units, want = larger
    if how.get("cell") == 6:
        assert len(nearest.draw_anchors(units, 64, 6)[0]) > 4096
    got = {tuple(r)[:2] for r in nearest.most_similar(units, **how).collect()}
    assert len(got & want) / len(want) > (0.999 if how.get("exact") else 0.97)
    assert len(got & want) / len(got) > 0.97


def test_cut_cells_lose_nothing(spark, data, monkeypatch):
    units = spark.read.parquet(f"{data}/units.parquet")
    whole = {tuple(r) for r in nearest.most_similar(units).collect()}
    anchors = nearest.draw_anchors(units, 64)[0]
    monkeypatch.setattr(nearest, "draw_anchors", lambda *a: (anchors, np.full(len(anchors), 3)))
    monkeypatch.setattr(nearest, "BLOCK", 100)
    cut = {tuple(r) for r in nearest.most_similar(units).collect()}
    exact = {tuple(r) for r in nearest.most_similar(units, exact=True).collect()}
    assert len(cut & exact) > 0.98 * len(exact) and len(whole & cut) > 0.98 * len(whole)


def test_nearest_edges(spark):
    base = np.random.default_rng(0).standard_normal((3, 4))
    rows = [(f"c{i:02d}", 1, base[0].tolist()) for i in range(9)] + [("near", 1, (base[0] + 0.05).tolist()), ("far", 1, base[1].tolist()), ("zero", 1, [0.0] * 4), ("short", 1, [1.0]), ("null", 1, None), ("nan", 1, [1.0, float("nan"), 0.0, 0.0]), ("hole", 1, [1.0, None, 0.0, 0.0]), ("gone", 1, base[0].tolist()), ("gone", 2, None), (None, 1, base[0].tolist())]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "unit_id string, seq long, vector array<float>, cos double")
    pairs = {tuple(r)[:2] for r in nearest.most_similar(df, 5, 0.85, 4).collect()}
    ids = {i for p in pairs for i in p}
    assert ids == {f"c{i:02d}" for i in range(9)} | {"near"}
    assert all(a < b for a, b in pairs)
    assert all(sum(c in p for p in pairs) >= 5 for c in ids)
    assert nearest.most_similar(df.limit(0), 5, 0.85, 4).count() == 0
    assert nearest.most_similar(df.where("unit_id = 'far'"), 5, 0.85, 4).count() == 0


def test_bpe_documents(spark):
    df = spark.createDataFrame([(1, "Hello world", "t"), (2, None, "t"), (3, "", "t")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bytebpe.encode_documents(df).collect()}
    assert got == {1: [15496, 995], 2: [], 3: []}
    assert bytebpe.encode_documents(df.limit(0)).count() == 0


def test_leaks_and_spam(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(7, "s", "en", "q", passage, None), (8, "s", None, None, None, None)], "item_id long, suite string, lang string, question string, passage string, answer string")
    docs = spark.createDataFrame([(1, passage, 1), (1, passage, 1), (2, None, 1), (3, "", 1), (4, "buy tea mill, " * 30, 2)], "doc_id long, text string, item_id int")
    assert [tuple(r) for r in leaks.leaks_found(docs, items).collect()] == [(1, 7)]
    assert leaks.leaks_found(docs.limit(0), items).count() == 0 and leaks.leaks_found(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in spampages.spam_pages(docs).collect()] == [(4,)]
    assert spampages.spam_pages(docs.limit(0)).count() == 0


def test_items_indexed_in_parts_leak_the_same(spark, data, monkeypatch):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "eval_items"))
    whole = {tuple(r) for r in leaks.leaks_found(docs, items).collect()}
    monkeypatch.setattr(leaks, "PART_CHARS", 20_000)
    assert {tuple(r) for r in leaks.leaks_found(docs, items).collect()} == whole and whole


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)
    if name.endswith("_found"):
        assert df.count() == df.distinct().count()


def test_nothing_else_imports_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parents[2] / "quillspan"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text(encoding="utf-8")), p
