"""Registered queries of the engine's operators over whole tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..builder import content, contains, length, meta, ref, select, similarity
from ..engine import Engine
from ..functions.registry import Signature
from ..functions.types import TypeHandler
from ..operators import metrics, vectors
from ..operators import text as text_ops
from ..operators.embed import HashEmbedder, embed_cached, embed_column
from ..operators.rerank import TokenOverlap, overlap
from ..sources.collection import PAYLOAD, Collection, of_table, split_units, upsert
from ..sources.files import load_documents
from ..sources.store import Files, Store
from . import schema, translate
from .analyze import PROFILES
from .parse import parse
from .plan import neighbours

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
FIELDS = ("lang", "source", "n_chars", "title", "category", "status", "published", "crawled_at")
DIM = 64


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> Collection:
    return of_table(table(spark, d, "documents"), "doc_id", "text", FIELDS)


def embeddings(spark: SparkSession, d: str) -> Collection:
    return of_table(table(spark, d, "embeddings"), "vec_id", F.col("vec_id").cast("string"), ["label"], {"default": "embedding"})


def events(spark: SparkSession, d: str) -> Collection:
    df = table(spark, d, "events").withColumn("props", F.parse_json("props"))
    return of_table(df, "event_id", "event_type", ["ts", "event_type", "value", "props"])


def store_docs(spark: SparkSession, d: str) -> Collection:
    """Current versions; metadata stays an open map of strings."""
    df = table(spark, d, "store_docs").groupBy("doc_key").agg(F.max_by(F.struct("seq", "payloads", "metadata", "source"), "seq").alias("r"))
    text = F.array_join(F.transform(F.filter("r.payloads", lambda p: p["modality"] == "text"), lambda p: p["data"]), " ")
    units = df.select(F.col("doc_key").alias("unit_id"), F.col("doc_key").alias("doc_id"), F.lit(0).alias("ordinal"), F.col("r.seq").alias("seq"), text.alias("content"), F.col("r.metadata").alias("metadata"))
    return Collection(units, "document", {}, "metadata", {}, units.select("doc_id", "content", "metadata"))


def stored_units(spark: SparkSession, d: str) -> Collection:
    """Current units with usable vectors, brought to unit length."""
    from ..operators.embed import unit_vector

    df = table(spark, d, "units").groupBy("unit_id").agg(F.max_by(F.struct("doc_key", "ordinal", "seq", "kind", "status", "year_no", "vector"), "seq").alias("r")).select("unit_id", "r.*")
    ok = (F.size("vector") == DIM) & F.exists("vector", lambda x: x != 0)
    df = df.where(ok).withColumn("vector", unit_vector(F.col("vector")))
    return of_table(df, "unit_id", "unit_id", ["kind", "status", "year_no"], {"default": "vector"}, granularity="chunk", doc_id="doc_key", ordinal="ordinal", seq="seq")


def units_or_null(spark: SparkSession, d: str) -> Collection:
    """Current units, usable vectors or not."""
    df = table(spark, d, "units").groupBy("unit_id").agg(F.max_by(F.struct("doc_key", "ordinal", "seq", "kind", "year_no"), "seq").alias("r")).select("unit_id", "r.*")
    return of_table(df, "unit_id", "unit_id", ["kind", "year_no"], granularity="chunk", doc_id="doc_key", ordinal="ordinal", seq="seq")


def search(c: Collection, text: str, *columns: str, **how) -> DataFrame:
    e = Engine(c.units.sparkSession, c, insertion_order=False, **{k: how.pop(k) for k in list(how) if k in ("field_types", "strict", "embedder", "reranker", "registry")})
    for name, ext in how.pop("functions", {}).items():
        e.register_function(name, **ext)
    for name, ext in how.pop("types", {}).items():
        e.register_type(name, ext)
    df = e.search(text, **how)
    return df.select(*columns) if columns else df


def workspace(spark: SparkSession) -> str:
    """A folder of the cluster's shared one (of the machine's own only where none is set), gone when the session ends."""
    import tempfile
    import uuid

    root = (spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}").rstrip("/")
    name = f"{root}/quillspan-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return name


def payload(text: Column) -> Column:
    one = F.struct(F.lit("text").alias("modality"), text.alias("text"), F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast("string").alias("uri"), F.lit("text/plain").alias("mime"))
    return F.array(one).alias("payloads")


def stored_documents(spark: SparkSession, d: str) -> Engine:
    """The documents in a store by sentences, the drafts among them added a second time with another text."""
    e = Engine(spark, store=Store(spark, workspace(spark), {"lang": "string", "n_chars": "bigint"}), granularity="sentence")
    df = table(spark, d, "documents").where("text is not null")
    rows = lambda x, t: x.select(F.col("doc_id").cast("string").alias("doc_id"), payload(t), F.to_variant_object(F.struct("lang", "n_chars")).alias("metadata"), "source")
    e.add_documents(rows(df, F.col("text")))
    e.add_documents(rows(df.where("status = 'draft'"), F.concat(F.lit("Again. "), F.col("text"))))
    return e


def stored_vectors(spark: SparkSession, d: str, cells: int = 0, profile: str = "local") -> Engine:
    """The embeddings as units of a store, in cells if asked for."""
    store = Store(spark, workspace(spark), {"label": "bigint"})
    units = table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("unit_id"), F.col("vec_id").cast("string").alias("doc_id"), F.lit("chunk").alias("kind"), F.col("vec_id").alias("doc_no"), F.lit(0).alias("ordinal"), F.lit("").alias("content"),
        F.lit(None).cast(PAYLOAD).alias("payload"), F.to_variant_object(F.struct("label")).alias("metadata"), F.col("embedding").alias("vector"), F.lit(None).cast("map<string,array<float>>").alias("vectors"),
    )
    store.append(None, units, require_vectors=True)
    if cells:
        store.build_cells(cells, probes=cells)
    return Engine(spark, store=store, granularity="chunk", profile=PROFILES[profile])


def vector_of(spark: SparkSession, d: str, ident: int) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == ident).select("embedding").first()[0])


# SQL pieces

_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _split(x: str) -> str:
    cut = f"regexp_replace(regexp_replace(regexp_replace({_strip(x)}, '([.!?]){_WS}+', '\\1' || chr(30), 'g'), '([。！？…]){_WS}*', '\\1' || chr(30), 'g'), '\\n+', chr(30), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(30)), lambda s: {_strip('s')}), lambda s: length(s) > 0)"


_SENT = f"""sent AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS seq, lang, source, n_chars, unnest({_split('text')}) AS content,
              unnest(range(len({_split('text')}))) AS ordinal FROM documents WHERE text IS NOT NULL)"""
_CHUNKS = f"""packed AS (SELECT doc_id, list_reduce(list_prepend('', {_split('text')}), lambda a, s:
                CASE WHEN a = '' THEN s
                     WHEN length(string_split(a, chr(31))[-1]) + length(s) + 1 > 1000 THEN a || chr(31) || s
                     ELSE a || ' ' || s END) AS p, text FROM documents WHERE text IS NOT NULL),
     ch AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS seq, unnest(string_split(p, chr(31))) AS content, unnest(range(len(string_split(p, chr(31))))) AS ordinal FROM packed WHERE p <> '')"""
_NUM = r"'(?i)^[+-]?(?:(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+(?:_[0-9]+)*)?)\s*$'"
_DATE = r"'^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}(?::[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{3}(?:[0-9]{3})?)?)?)?)?$'"


def _number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {_NUM}) THEN try_cast(regexp_replace({x}, '[_\\s]', '', 'g') AS DOUBLE) END"


def _date(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {_DATE}) THEN try_cast(CASE WHEN regexp_matches({x}, '[T ][0-9]{{2}}$') THEN {x} || ':00' ELSE {x} END AS TIMESTAMP) WHEN regexp_matches({x}, '^[0-9]{{8}}$') THEN try_strptime({x}, '%Y%m%d') END"


_CUR = "cur AS (SELECT * FROM store_docs QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY seq DESC) = 1)"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def _cos(a: str, b: str) -> str:
    return _DOT.format(a=a, b=b)


# predicates


@_query("scan_eq", "SELECT CAST(doc_id AS VARCHAR) AS unit_id FROM documents WHERE lang = 'en' AND category = 'kitchen'")
def _(s, d):
    return search(documents(s, d), 'SELECT DOCUMENT WHERE meta.lang == "en" AND category == "kitchen"', "unit_id")


@_query("scan_neq_null", "SELECT CAST(doc_id AS VARCHAR) AS unit_id FROM documents WHERE status IS DISTINCT FROM 'draft'")
def _(s, d):
    return search(documents(s, d), 'SELECT DOCUMENT WHERE meta.status != "draft"', "unit_id")


@_query("scan_range", "SELECT CAST(doc_id AS VARCHAR) AS unit_id, n_chars AS n FROM documents WHERE n_chars >= 500 AND n_chars < 900.5")
def _(s, d):
    return search(documents(s, d), "SELECT DOCUMENT LET n = n_chars WHERE 500 <= meta.n_chars AND meta.n_chars < 900.5", "unit_id", "n")


@_query("null_not_ordered", "SELECT unit_id FROM (SELECT * FROM units QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY seq DESC) = 1) WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0 AND NOT coalesce(year_no > 2023, false)")
def _(s, d):
    return search(stored_units(s, d), "SELECT CHUNK WHERE NOT meta.year_no > 2023", "unit_id")


@_query("eq_null", "SELECT CAST(doc_id AS VARCHAR) AS unit_id FROM documents WHERE category IS NULL")
def _(s, d):
    return search(documents(s, d), "SELECT DOCUMENT WHERE meta.category == null", "unit_id")


@_query("bool_algebra", "SELECT CAST(doc_id AS VARCHAR) AS unit_id FROM documents WHERE (coalesce(lang = 'fr', false) OR coalesce(lang = 'de', false)) AND NOT (coalesce(n_chars > 800, false) OR coalesce(source = 'src_07', false))")
def _(s, d):
    return search(documents(s, d), 'SELECT DOCUMENT WHERE (meta.lang == "fr" OR meta.lang == "de") AND NOT (n_chars > 800 OR source == "src_07")', "unit_id")


@_query("truthiness", "SELECT CAST(doc_id AS VARCHAR) AS unit_id FROM documents WHERE coalesce(title <> '', false) AND coalesce(n_chars <> 0, false)")
def _(s, d):
    return search(documents(s, d), "SELECT DOCUMENT WHERE meta.title AND n_chars", "unit_id")


@_query("contains_ci", "SELECT CAST(doc_id AS VARCHAR) AS unit_id FROM documents WHERE contains(lower(text), 'the tool agent')")
def _(s, d):
    return search(documents(s, d), 'SELECT DOCUMENT WHERE content CONTAINS "The Tool AGENT"', "unit_id")


@_query("match_regex", r"SELECT CAST(doc_id AS VARCHAR) AS unit_id FROM documents WHERE regexp_matches(text, '[0-9]{3} (times|copies)')")
def _(s, d):
    return search(documents(s, d), 'SELECT DOCUMENT WHERE content MATCH "[0-9]{3} (times|copies)"', "unit_id")


@_query("like_wildcard", "SELECT CAST(doc_id AS VARCHAR) AS unit_id FROM documents WHERE text LIKE 'The %s_o%re%'")
def _(s, d):
    return search(documents(s, d), 'SELECT DOCUMENT WHERE LIKE(content, "The %s_o%re%")', "unit_id")


@_query("operand_flip", "SELECT CAST(doc_id AS VARCHAR) AS unit_id FROM documents WHERE n_chars > 1500 AND lang IS DISTINCT FROM 'en'")
def _(s, d):
    return search(documents(s, d), 'SELECT DOCUMENT WHERE 1500 < n_chars AND "en" != lang', "unit_id")


# functions


@_query("fn_length_count", "SELECT CAST(doc_id AS VARCHAR) AS unit_id, length(text) AS n, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS BIGINT) AS c FROM documents")
def _(s, d):
    return search(documents(s, d), 'SELECT DOCUMENT LET n = LENGTH(content), c = COUNT(content, "The")', "unit_id", "n", "c")


@_query("fn_lower_nested", "SELECT CAST(doc_id AS VARCHAR) AS unit_id, length(lower(title)) AS n FROM documents WHERE contains(lower(title), 'the')")
def _(s, d):
    return search(documents(s, d), 'SELECT DOCUMENT LET n = LENGTH(LOWER(meta.title)) WHERE CONTAINS(LOWER(title), LOWER("The"))', "unit_id", "n")


@_query("fn_upper", "SELECT CAST(doc_id AS VARCHAR) AS unit_id, upper(replace(source, 'ß', 'SS')) AS u FROM documents WHERE source IS NOT NULL")
def _(s, d):
    return search(documents(s, d), "SELECT DOCUMENT LET u = UPPER(meta.source) WHERE source != null", "unit_id", "u")


# coercion


@_query("coerce_numeric_string", f"WITH {_CUR}, v AS (SELECT doc_key, metadata['year'] AS y FROM cur) SELECT doc_key AS unit_id FROM v WHERE coalesce(({_number('y')}) >= 2024, false)")
def _(s, d):
    return search(store_docs(s, d), "SELECT DOCUMENT WHERE meta.year >= 2024", "unit_id", strict=False)


@_query("coerce_equal_number", f"WITH {_CUR}, v AS (SELECT doc_key, metadata['year'] AS y FROM cur) SELECT doc_key AS unit_id FROM v WHERE coalesce(({_number('y')}) = 2024, false)")
def _(s, d):
    return search(store_docs(s, d), "SELECT DOCUMENT WHERE meta.year == 2024", "unit_id")


@_query("coerce_text_hint", f"WITH {_CUR} SELECT doc_key AS unit_id FROM cur WHERE coalesce(metadata['year'] = '2024', false)")
def _(s, d):
    return search(store_docs(s, d), 'SELECT DOCUMENT WHERE meta.year == TEXT "2024"', "unit_id")


@_query("coerce_date_hint", f"WITH {_CUR}, v AS (SELECT doc_key, metadata['date'] AS y FROM cur) SELECT doc_key AS unit_id FROM v WHERE CASE WHEN ({_date('y')}) IS NOT NULL THEN ({_date('y')}) >= TIMESTAMP '2024-06-01' ELSE coalesce(y >= '2024-06-01', false) END")
def _(s, d):
    return search(store_docs(s, d), 'SELECT DOCUMENT WHERE meta.date >= DATE "2024-06-01"', "unit_id")


@_query("coerce_declared_number", f"WITH {_CUR}, v AS (SELECT doc_key, metadata['year'] AS y FROM cur) SELECT doc_key AS unit_id FROM v WHERE CASE WHEN ({_number('y')}) IS NOT NULL THEN ({_number('y')}) < 2024 ELSE coalesce(y < '2024', false) END")
def _(s, d):
    return search(store_docs(s, d), 'SELECT DOCUMENT WHERE meta.year < "2024"', "unit_id", field_types={"year": "number"})


@_query("date_range_typed", "SELECT CAST(event_id AS VARCHAR) AS unit_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12 06:00:00' AND event_type = 'click'")
def _(s, d):
    return search(events(s, d), 'SELECT DOCUMENT WHERE meta.ts >= DATE "2024-01-10" AND ts < "2024-01-12T06:00:00" AND event_type == "click"', "unit_id")


@_query("nested_path", "SELECT CAST(event_id AS VARCHAR) AS unit_id FROM events WHERE CAST(props->>'$.k' AS DOUBLE) >= 50")
def _(s, d):
    return search(events(s, d), "SELECT DOCUMENT WHERE meta.props.k >= 50", "unit_id")


# order and limit


@_query("order_multi", "SELECT CAST(doc_id AS VARCHAR) AS unit_id FROM documents ORDER BY lang ASC NULLS LAST, n_chars DESC NULLS FIRST, doc_id LIMIT 25")
def _(s, d):
    return search(documents(s, d), "SELECT DOCUMENT ORDER BY lang, n_chars DESC LIMIT 25", "unit_id", field_types={"lang": "text"})


@_query("order_nulls_first", "SELECT unit_id FROM units QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY seq DESC) = 1 ORDER BY year_no DESC NULLS FIRST, kind ASC NULLS LAST, seq, unit_id LIMIT 40")
def _(s, d):
    return search(units_or_null(s, d), "SELECT CHUNK ORDER BY meta.year_no DESC, kind LIMIT 40", "unit_id", field_types={"kind": "text"})


@_query("order_expr", "SELECT CAST(doc_id AS VARCHAR) AS unit_id FROM documents WHERE lang = 'en' ORDER BY length(text) DESC NULLS FIRST, doc_id LIMIT 10")
def _(s, d):
    return search(documents(s, d), 'SELECT DOCUMENT WHERE lang == "en" ORDER BY LENGTH(content) DESC LIMIT 10', "unit_id")


@_query("order_mixed_strings", f"WITH {_CUR}, v AS (SELECT doc_key, seq, metadata['date'] AS y FROM cur), k AS (SELECT *, {_date('y')} AS t FROM v) SELECT doc_key AS unit_id FROM k ORDER BY CASE WHEN y IS NULL THEN 3 WHEN t IS NOT NULL THEN 1 ELSE 2 END, epoch(t), CASE WHEN t IS NULL THEN y END, seq, doc_key LIMIT 60")
def _(s, d):
    return search(store_docs(s, d), "SELECT DOCUMENT ORDER BY meta.date LIMIT 60", "unit_id")


@_query("limit_override", "SELECT CAST(doc_id AS VARCHAR) AS unit_id FROM documents WHERE status = 'published' ORDER BY doc_id LIMIT 7")
def _(s, d):
    return search(documents(s, d), 'SELECT DOCUMENT WHERE status == "published" LIMIT 50', "unit_id", limit=7)


# vectors

_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_Q1 = "(SELECT embedding FROM embeddings WHERE vec_id = 1)"


@_query("topk", f"SELECT CAST(vec_id AS VARCHAR) AS unit_id, round({_cos('embedding', _Q0)}, 6) AS score FROM embeddings ORDER BY {_cos('embedding', _Q0)} DESC, vec_id LIMIT 10")
def _(s, d):
    df = search(embeddings(s, d), 'SELECT DOCUMENT LET score = SIMILARITY(content, "q") ORDER BY score DESC LIMIT 10', vectors={"q": vector_of(s, d, 0)})
    return df.select("unit_id", F.round("score", 6).alias("score"))


@_query("topk_default_order", f"SELECT CAST(vec_id AS VARCHAR) AS unit_id FROM embeddings ORDER BY {_cos('embedding', _Q1)} DESC, vec_id LIMIT 15")
def _(s, d):
    return search(embeddings(s, d), 'SELECT DOCUMENT LET r = SIMILARITY(content, "q") LIMIT 15', "unit_id", vectors={"q": vector_of(s, d, 1)})


@_query("topk_prefilter", f"SELECT CAST(vec_id AS VARCHAR) AS unit_id FROM embeddings WHERE label >= 5 ORDER BY {_cos('embedding', _Q0)} DESC, vec_id LIMIT 10")
def _(s, d):
    return search(embeddings(s, d), 'SELECT DOCUMENT WHERE meta.label >= 5 ORDER BY SIMILARITY(content, "q") DESC LIMIT 10', "unit_id", vectors={"q": vector_of(s, d, 0)})


@_query("score_threshold_multi", f"SELECT CAST(vec_id AS VARCHAR) AS unit_id, round({_cos('embedding', _Q0)}, 6) AS a, round({_cos('embedding', _Q1)}, 6) AS b FROM embeddings WHERE {_cos('embedding', _Q0)} >= 0.1 OR {_cos('embedding', _Q1)} > 0.2 ORDER BY {_cos('embedding', _Q1)} DESC, vec_id LIMIT 50")
def _(s, d):
    q = 'SELECT DOCUMENT LET a = SIMILARITY(content, "x"), b = similarity(content, "y") WHERE a >= 0.1 OR b > 0.2 ORDER BY b DESC LIMIT 50'
    df = search(embeddings(s, d), q, vectors={"x": vector_of(s, d, 0), "y": vector_of(s, d, 1)})
    return df.select("unit_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@_query("named_vector_missing", f"SELECT CAST(doc_id AS VARCHAR) AS unit_id, round(coalesce({_cos('embedding', _Q0)}, -2.0), 6) AS a FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def _(s, d):
    df = table(s, d, "documents").join(table(s, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    c = of_table(df, "doc_id", "text", FIELDS, {"emb": "embedding"})
    return search(c, 'SELECT DOCUMENT LET a = SIMILARITY(vec.emb, "q")', vectors={"q": vector_of(s, d, 0)}).select("unit_id", F.round("a", 6).alias("a"))


@_query("batch_topk", f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_cos('a.embedding', 'b.embedding')} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
    SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM p QUALIFY rank <= 5""")
def _(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.batch_top_k(e, "vec_id", "embedding", q, 5).select("query_id", "vec_id", "rank")


@_query("units_topk_filtered", """WITH c AS (SELECT * FROM units QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY seq DESC) = 1),
    u AS (SELECT *, sqrt(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM c WHERE len(vector) = 64),
    s AS (SELECT unit_id, seq, list_sum(list_transform(list_zip(vector, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda p: CAST(CAST(CAST(p[1] AS DOUBLE) / n AS FLOAT) AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS s FROM u WHERE n > 0 AND status = 'published')
    SELECT unit_id FROM s ORDER BY s DESC, seq, unit_id LIMIT 20""")
def _(s, d):
    return search(stored_units(s, d), 'SELECT CHUNK WHERE meta.status == "published" ORDER BY SIMILARITY(content, "q") DESC LIMIT 20', "unit_id", vectors={"q": vector_of(s, d, 0)})


# text units and granularity


@_query("sentences", f"WITH {_SENT} SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, content FROM sent")
def _(s, d):
    return split_units(documents(s, d), "sentence").units.select("doc_id", "ordinal", "content")


@_query("chunks", f"WITH {_CHUNKS} SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, content FROM ch")
def _(s, d):
    return split_units(documents(s, d), "chunk").units.select("doc_id", "ordinal", "content")


_NEAR = """SELECT h.doc_id || '#span:' || h.ordinal || '~2' AS unit_id, CAST(min(n.ordinal) AS INTEGER) AS span_start, CAST(max(n.ordinal) AS INTEGER) AS span_end, string_agg(n.content, ' ' ORDER BY n.ordinal) AS content
    FROM {hits} h JOIN sent n ON n.doc_id = h.doc_id AND n.ordinal BETWEEN h.ordinal - 2 AND h.ordinal + 2 GROUP BY h.doc_id, h.ordinal"""


@_query("span_sentences", f"WITH {_SENT} " + _NEAR.format(hits="(SELECT * FROM sent WHERE contains(lower(content), 'tool agent'))"))
def _(s, d):
    return search(split_units(documents(s, d), "sentence"), 'SELECT SPAN(SENTENCE, window => 2) WHERE content CONTAINS "tool agent"', "unit_id", "span_start", "span_end", "content")


@_query("span_limit", f"WITH {_SENT} " + _NEAR.format(hits="(SELECT * FROM sent WHERE contains(content, 'metadata mask') ORDER BY length(content) DESC, seq, ordinal LIMIT 12)"))
def _(s, d):
    return search(split_units(documents(s, d), "sentence"), 'SELECT SPAN(SENTENCE, 2) WHERE content LIKE "%metadata mask%" ORDER BY LENGTH(content) DESC LIMIT 12', "unit_id", "span_start", "span_end", "content")


@_query("document_best", f"WITH {_SENT}, b AS (SELECT doc_id, length(content) AS n FROM sent WHERE contains(lower(content), 'metadata mask') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(content) DESC, ordinal) = 1) SELECT b.doc_id AS unit_id, n, text AS content FROM b JOIN documents d ON CAST(d.doc_id AS VARCHAR) = b.doc_id")
def _(s, d):
    return search(split_units(documents(s, d), "sentence"), 'SELECT DOCUMENT LET n = LENGTH(content) WHERE content CONTAINS "Metadata Mask" ORDER BY n DESC', "unit_id", "n", "content")


@_query("chunk_from_sentences", f"WITH {_SENT} SELECT doc_id || '#chunk' AS unit_id, string_agg(content, ' ' ORDER BY length(content) DESC, ordinal) AS content FROM sent WHERE contains(lower(content), 'tool agent') GROUP BY doc_id")
def _(s, d):
    return search(split_units(documents(s, d), "sentence"), 'SELECT CHUNK WHERE content CONTAINS "tool agent" ORDER BY LENGTH(content) DESC', "unit_id", "content")


@_query("sentence_from_chunks", f"""WITH {_CHUNKS}, h AS (SELECT doc_id, ordinal, {_split('content')} AS l FROM ch WHERE contains(lower(content), 'tool agent')),
    x AS (SELECT doc_id, ordinal, unnest(l) AS content, unnest(range(len(l))) AS i FROM h)
    SELECT doc_id || '#sent:' || ordinal || ':' || i AS unit_id, CAST(ordinal + i AS INTEGER) AS ordinal, content FROM x""")
def _(s, d):
    return search(split_units(documents(s, d), "chunk"), 'SELECT SENTENCE WHERE content CONTAINS "tool agent"', "unit_id", "ordinal", "content")


@_query("order_lines_span", """SELECT l.l_orderkey || '#span:' || l.l_linenumber || '~1' AS unit_id, string_agg(n.l_returnflag, ' ' ORDER BY n.l_linenumber) AS content
    FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 50) l JOIN (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) n
      ON n.l_orderkey = l.l_orderkey AND n.l_linenumber BETWEEN l.l_linenumber - 1 AND l.l_linenumber + 1 GROUP BY l.l_orderkey, l.l_linenumber""")
def _(s, d):
    lines = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.max("l_quantity").alias("quantity"))
    lines = lines.withColumn("id", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    c = of_table(lines, "id", "flag", ["quantity"], granularity="sentence", doc_id="l_orderkey", ordinal="l_linenumber", seq="l_orderkey")
    return search(c, "SELECT SPAN(SENTENCE) WHERE meta.quantity >= 50", "unit_id", "content")


@_query("detect_script", r"SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\x{3000}-\x{9FFF}\x{FF00}-\x{FFEF}]', '', 'g')) / nullif(length(regexp_replace(text, '" + _WS + r"', '', 'g')), 0) > 0.2 THEN 'cjk' ELSE 'latin' END AS script FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text_ops.script(F.col("text")).alias("script"))


_NORM = r"regexp_replace(regexp_replace({x}, '[ \t\x{A0}\x{3000}]+', ' ', 'g'), '\n{2,}', chr(10), 'g')"


def _normal(x: str) -> str:
    """The default normaliser in SQL."""
    lines = _NORM.replace("{x}", f"nfc_normalize({x})")
    return _strip(f"list_reduce(list_transform(string_split({lines}, chr(10)), lambda l: {_strip('l')}), lambda a, b: a || chr(10) || b)")


@_query("normalize", f"SELECT doc_id, {_normal('text')} AS t FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text_ops.normalize(F.col("text")).alias("t"))


# rerank and metrics


@_query("rerank_overlap", "SELECT doc_id, round(len(list_intersect(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '" + _WS + "+')), ['tool', 'agent', 'checks', 'the'])) / 4.0, 6) AS o FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.round(overlap("the tool agent checks", F.col("text")), 6).alias("o"))


@_query("rerank_two_stage", f"""WITH first AS (SELECT vec_id, {_cos('embedding', _Q0)} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 50)
    SELECT CAST(vec_id AS VARCHAR) AS unit_id FROM first ORDER BY CASE WHEN vec_id = 7 THEN 1 ELSE 0 END DESC, s DESC, vec_id LIMIT 10""")
def _(s, d):
    return search(embeddings(s, d), 'SELECT DOCUMENT LET r = SIMILARITY(content, "q") LIMIT 10', "unit_id", vectors={"q": vector_of(s, d, 0)}, reranker=TokenOverlap(), rerank_query="7")


@_query("metrics", f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label = b.label AS good, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_cos('a.embedding', 'b.embedding')} DESC, b.vec_id) AS rank
      FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
    SELECT query_id, round(count(*) FILTER (good AND rank <= 50) / count(*) FILTER (good), 6) AS hit_rate, round(count(*) FILTER (good AND rank <= 10) / count(*) FILTER (good), 6) AS recall_at_k, round(coalesce(1.0 / min(rank) FILTER (good AND rank <= 50), 0), 6) AS reciprocal_rank FROM p GROUP BY query_id""")
def _(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 20 = 0")
    ranked = vectors.batch_top_k(e, "vec_id", "embedding", q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 50).select("query_id", F.col("vec_id").alias("id"), "rank")
    gold = q.select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("id"), "label"), "label").select("query_id", "id")
    return metrics.per_query(ranked, gold, 10).select("query_id", F.round("hit_rate", 6).alias("hit_rate"), F.round("recall_at_k", 6).alias("recall_at_k"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@_query("condition_precision", "SELECT lang AS query_id, round(avg(CASE WHEN coalesce(status = 'published', false) THEN 1.0 ELSE 0.0 END), 6) AS precision FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def _(s, d):
    df = table(s, d, "documents").where("lang is not null").withColumn("query_id", F.col("lang"))
    return metrics.condition_precision(df, F.col("status") == "published").select("query_id", F.round("precision", 6).alias("precision"))


@_query("dedup_by_text", "SELECT substr(md5(text), 1, 10) AS doc_hash, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(s, d):
    return metrics.dedup_by_text(table(s, d, "documents").where("text is not null")).select("doc_hash", "text")


# extensions


@_query("udf_column", "SELECT CAST(doc_id AS VARCHAR) AS unit_id, length(text) - length(replace(text, ' ', '')) AS w FROM documents WHERE length(text) - length(replace(text, ' ', '')) > 200")
def _(s, d):
    blanks = {"BLANKS": {"signature": Signature(("text",), "bigint"), "build": lambda t: (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))).cast("bigint")}}
    return search(documents(s, d), "SELECT DOCUMENT LET w = BLANKS(content) WHERE w > 200", "unit_id", "w", functions=blanks)


@_query("udf_python", "SELECT CAST(doc_id AS VARCHAR) AS unit_id FROM documents WHERE title IS NOT NULL AND length(title) % 7 = 0")
def _(s, d):
    seven = {"SEVENTH": {"signature": Signature(("text",), "bool"), "python": lambda t: t is not None and len(t) % 7 == 0}}
    return search(documents(s, d), "SELECT DOCUMENT WHERE SEVENTH(meta.title)", "unit_id", functions=seven)


_PARTS = "part AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, unnest(string_split(text, ', ')) AS content, unnest(range(len(string_split(text, ', ')))) AS n FROM documents WHERE text IS NOT NULL)"


@_query("splitter_custom", f"WITH {_PARTS} SELECT doc_id || '#sent:0:' || n AS unit_id, content FROM part WHERE contains(lower(text), 'harbour')")
def _(s, d):
    e = Engine(s, documents(s, d))
    e.register_splitter("SENTENCE", python=lambda t: [] if t is None else t.split(", "), overwrite=True)
    return e.search('SELECT SENTENCE WHERE content CONTAINS "harbour"').select("unit_id", "content")


@_query("span_custom_splitter", f"""WITH {_PARTS} SELECT h.doc_id || '#span:' || h.n || '~1' AS unit_id, string_agg(u.content, ' ' ORDER BY u.n) AS content
    FROM part h JOIN part u ON u.doc_id = h.doc_id AND u.n BETWEEN h.n - 1 AND h.n + 1 WHERE contains(lower(h.text), 'harbour') GROUP BY h.doc_id, h.n""")
def _(s, d):
    e = Engine(s, documents(s, d))
    e.register_splitter("SENTENCE", build=lambda t: F.split(t, ", ", -1), overwrite=True)
    return e.search('SELECT SPAN(SENTENCE, 1) WHERE content CONTAINS "harbour"').select("unit_id", "content")


@_query("sentence_limit_blank", f"WITH {_SENT} SELECT s.doc_id || '#sent:0:' || ordinal AS unit_id, content FROM sent s JOIN documents d ON CAST(d.doc_id AS VARCHAR) = s.doc_id ORDER BY length(text), seq, ordinal LIMIT 25")
def _(s, d):
    return search(documents(s, d), "SELECT SENTENCE ORDER BY LENGTH(content) LIMIT 25", "unit_id", "content")


@_query("type_custom", "SELECT CAST(doc_id AS VARCHAR) AS unit_id FROM documents WHERE coalesce(CAST(substr(source, 5) AS INTEGER) > 30, false)")
def _(s, d):
    number = TypeHandler("srcno", lambda x: int(x[4:]), parse_column=lambda c: F.substring(c, 5, 10).try_cast("int"))
    return search(documents(s, d), 'SELECT DOCUMENT WHERE meta.source > SRCNO "src_30"', "unit_id", types={"srcno": number})


@_query("builder_equivalent", "SELECT CAST(doc_id AS VARCHAR) AS unit_id, length(text) AS n FROM documents WHERE coalesce(n_chars >= 300, false) AND contains(lower(text), 'harbour') AND NOT coalesce(lang = 'de', false)")
def _(s, d):
    q = select("document").let("n", length(content)).where(meta("n_chars") >= 300, contains(content, "harbour")).where(~(meta("lang") == "de")).order_by("n", desc=True)
    return search(documents(s, d), q, "unit_id", "n")


@_query("ir_document", "SELECT CAST(doc_id AS VARCHAR) AS unit_id FROM documents WHERE lang IN ('en', 'fr') AND length(text) > 2000")
def _(s, d):
    path = lambda *p: {"node": "path", "root": p[0], "segments": list(p[1:])}
    eq = lambda v: {"node": "compare", "op": "==", "left": path("meta", "lang"), "right": {"node": "literal", "value": v}}
    long = {"node": "compare", "op": ">", "left": {"node": "call", "name": "LENGTH", "args": [path("content")]}, "right": {"node": "literal", "value": 2000}}
    return search(documents(s, d), {"select": {"unit": "document"}, "where": {"node": "and", "operands": [{"node": "or", "operands": [eq("en"), eq("fr")]}, long]}}, "unit_id")


@_query("upsert_latest", "SELECT unit_id, seq, status FROM units QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY seq DESC) = 1")
def _(s, d):
    u = table(s, d, "units").select("unit_id", "seq", "status")
    return upsert(u.where("seq % 2 = 0"), u.where("seq % 2 = 1"), "unit_id", "seq")


@_query("document_lookup", "SELECT u.unit_id, s.doc_key IS NOT NULL AS there FROM (SELECT * FROM units QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY seq DESC) = 1) u LEFT JOIN (SELECT DISTINCT doc_key FROM store_docs) s ON u.doc_key = s.doc_key")
def _(s, d):
    u = upsert(table(s, d, "units").select("unit_id", "seq", "doc_key"), table(s, d, "units").select("unit_id", "seq", "doc_key").limit(0), "unit_id", "seq")
    docs = store_docs(s, d).documents.select(F.col("doc_id").alias("doc_key"), F.lit(True).alias("t"))
    return u.join(docs, "doc_key", "left").select("unit_id", F.coalesce("t", F.lit(False)).alias("there"))


_STORED = f"""kept AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, n_chars, {_split(_normal("CASE WHEN status = 'draft' THEN 'Again. ' || text ELSE text END"))} AS l FROM documents WHERE text IS NOT NULL),
     unit AS (SELECT doc_id, lang, n_chars, unnest(l) AS content, unnest(range(len(l))) AS ordinal FROM kept)"""


@_query("store_roundtrip", f"WITH {_STORED} SELECT doc_id || '#sentence:' || ordinal AS unit_id, CAST(ordinal AS INTEGER) AS ordinal, content FROM unit")
def _(s, d):
    return stored_documents(s, d).search("SELECT SENTENCE").select("unit_id", "ordinal", "content")


@_query("store_filtered", f"WITH {_STORED} SELECT doc_id || '#sentence:' || ordinal AS unit_id, content FROM unit WHERE lang = 'en' AND n_chars >= 500 AND contains(lower(content), 'again')")
def _(s, d):
    return stored_documents(s, d).search('SELECT SENTENCE WHERE lang == "en" AND meta.n_chars >= 500 AND content CONTAINS "again"').select("unit_id", "content")


@_query("neighbour_scan", f"""WITH {_STORED}, hit AS (SELECT doc_id, ordinal FROM unit WHERE contains(lower(content), 'harbour') ORDER BY length(content) DESC, doc_id, ordinal LIMIT 1)
    SELECT u.doc_id, CAST(u.ordinal AS INTEGER) AS ordinal, u.content FROM unit u JOIN hit h ON u.doc_id = h.doc_id AND u.ordinal BETWEEN h.ordinal - 3 AND h.ordinal + 3""")
def _(s, d):
    e = stored_documents(s, d)
    hit = e.search('SELECT SENTENCE WHERE content CONTAINS "harbour"').orderBy(F.length("content").desc(), "doc_id", "ordinal").first()
    return e.store.neighbours(hit.doc_id, hit.ordinal, 3).select("doc_id", "ordinal", "content")


@_query("store_count", f"WITH {_STORED} SELECT count(*) AS units FROM unit")
def _(s, d):
    return s.createDataFrame([(len(stored_documents(s, d)),)], "units bigint")


@_query("stream_ingest", f"""WITH kept AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_split(_normal('text'))} AS l FROM documents WHERE text IS NOT NULL)
    SELECT doc_id || '#sentence:' || unnest(range(len(l))) AS unit_id, unnest(l) AS content FROM kept""")
def _(s, d):
    """The documents as a stream of files, in micro-batches of one file each."""
    from ..streaming.ingest import ingest_stream

    folder = workspace(s)
    e = Engine(s, store=Store(s, f"{folder}/store"), granularity="sentence")
    df = table(s, d, "documents").where("text is not null").select("doc_id", "text", "source").repartition(3, "doc_id")
    df.select(F.col("doc_id").cast("string").alias("doc_id"), payload(F.col("text")), F.parse_json(F.lit("{}")).alias("metadata"), "source").write.parquet(f"{folder}/in")
    arriving = s.readStream.schema(s.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    ingest_stream(e, arriving, f"{folder}/checkpoint").awaitTermination()
    return e.search("SELECT SENTENCE").select("unit_id", "content")


@_query("store_document", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN status = 'draft' THEN 'Again. ' || text ELSE text END AS text FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE text IS NOT NULL AND status = 'draft')")
def _(s, d):
    first = table(s, d, "documents").where("text is not null and status = 'draft'").agg(F.min("doc_id")).first()[0]
    return stored_documents(s, d).store.document(str(first)).select("doc_id", F.col("payloads")[0]["text"].alias("text"))


@_query("stored_images_and_names", "SELECT * FROM (VALUES ('cat', 'image', 1.0, -2.0), ('note', 'text', -2.0, 1.0)) t(unit_id, modality, picture, title)")
def _(s, d):
    """An image and a unit with a named vector, each found by its own."""
    e = Engine(s, store=Store(s, workspace(s)), embedder=HashEmbedder(16), named_embedders={"title": HashEmbedder(8)}, granularity="chunk")
    e.add_image(b"a red cat", {"k": 1}, doc_id="cat")
    e.add_multivector("note", "body words", {"title": "blue whale"})
    both = e.search('SELECT CHUNK LET picture = SIMILARITY(content, "a red cat"), title = SIMILARITY(vec.title, "blue whale")')
    found = both.join(e.store.units().select("unit_id", "payload.modality"), "unit_id")
    missing = F.when(F.col("picture") > 0.999, 1.0).otherwise(-2.0)
    return found.select(F.col("doc_id").alias("unit_id"), "modality", missing.alias("picture"), F.round("title", 3).alias("title"))


@_query("hash_embedding", """SELECT * FROM (VALUES ('agents plan tasks', 0.0953::DOUBLE, 0.5673::DOUBLE, 0.8127::DOUBLE, 0.0926::DOUBLE), ('Agents  PLAN tasks', 0.0953::DOUBLE, 0.5673::DOUBLE, 0.8127::DOUBLE, 0.0926::DOUBLE), ('plan', 0.3168::DOUBLE, 0.1536::DOUBLE, 0.9039::DOUBLE, -0.2427::DOUBLE), ('', 0.7607::DOUBLE, -0.6042::DOUBLE, 0.0107::DOUBLE, 0.2370::DOUBLE)) t(text, x0, x1, x2, x3)""")
def _(s, d):
    """The seeded vectors of a few texts, which must be the same everywhere."""
    df = s.createDataFrame([("agents plan tasks",), ("Agents  PLAN tasks",), ("plan",), ("",)], "text string").withColumn("v", embed_column(F.col("text"), HashEmbedder(4)))
    return df.select("text", *[F.round(F.col("v")[i].cast("double"), 4).alias(f"x{i}") for i in range(4)])


@_query("store_topk", f"SELECT CAST(vec_id AS VARCHAR) AS unit_id, round({_cos('embedding', _Q0)}, 6) AS score FROM embeddings WHERE label >= 5 ORDER BY {_cos('embedding', _Q0)} DESC, vec_id LIMIT 10")
def _(s, d):
    e = stored_vectors(s, d)
    return e.search('SELECT CHUNK LET score = SIMILARITY(content, "q") WHERE meta.label >= 5 LIMIT 10', vectors={"q": vector_of(s, d, 0)}).select("unit_id", F.round("score", 6).alias("score"))


@_query("approximate_topk", f"SELECT CAST(vec_id AS VARCHAR) AS unit_id FROM embeddings WHERE label >= 5 ORDER BY {_cos('embedding', _Q1)} DESC, vec_id LIMIT 10")
def _(s, d):
    """The approximate way through the cells, reading all of them, which makes it exact."""
    e = stored_vectors(s, d, cells=12, profile="hnsw")
    return e.search('SELECT CHUNK LET r = SIMILARITY(content, "q") WHERE meta.label >= 5 ORDER BY r DESC LIMIT 10', vectors={"q": vector_of(s, d, 1)}).select("unit_id")


@_query("embedding_cache", f"WITH {_SENT} SELECT count(DISTINCT content) AS cached, CAST(0 AS BIGINT) AS again, count(*) AS units FROM sent")
def _(s, d):
    """Texts in the cache after the first and new ones after a second embedding of all sentences."""
    units, folder, e = split_units(documents(s, d), "sentence").units.select("unit_id", "content"), f"{workspace(s)}/cache", HashEmbedder(8)
    embed_cached(units, "content", e, folder)
    first = s.read.parquet(folder).count()
    both = embed_cached(units, "content", e, folder)
    again = s.read.parquet(folder).count() - first
    return both.where(F.size("vector") == 8).agg(F.lit(first).cast("bigint").alias("cached"), F.lit(again).cast("bigint").alias("again"), F.count("*").alias("units"))


_FILES = "SELECT CAST(item_id AS VARCHAR) AS doc_id, {text} AS text FROM eval_items WHERE passage IS NOT NULL"


@_query("load_text", _FILES.format(text="passage"))
def _(s, d):
    """Every passage as a file of its own, read by the loader of its extension."""
    files = Files(s, workspace(s))
    for r in table(s, d, "eval_items").where("passage is not null").select("item_id", "passage").collect():
        files.create(f"{r.item_id}.txt", r.passage)
    return load_documents(s, f"{files.path}/*.txt").select("doc_id", F.col("payloads")[0]["text"].alias("text"))


@_query("load_docx", _FILES.format(text="array_to_string(list_filter(string_split(passage, chr(10)), lambda l: trim(l) <> ''), chr(10))"))
def _(s, d):
    import io
    import zipfile
    from xml.sax.saxutils import escape

    space, files = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", Files(s, workspace(s))
    for r in table(s, d, "eval_items").where("passage is not null").select("item_id", "passage").collect():
        lines = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in r.passage.split("\n"))
        with zipfile.ZipFile(packed := io.BytesIO(), "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{lines}</w:body></w:document>')
        files.create(f"{r.item_id}.docx", packed.getvalue())
    return load_documents(s, f"{files.path}/*.docx").select("doc_id", F.col("payloads")[0]["text"].alias("text"))


@_query("distractors", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS gold FROM (SELECT doc_id FROM documents WHERE lang IS DISTINCT FROM 'en' LIMIT 100)")
def _(s, d):
    """A seeded sample (its feature): how many rows, and how many of the gold ones among them."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return metrics.distractors(docs, docs.where("lang = 'en'"), 100).agg(F.count("*").alias("n"), F.count(F.when(F.col("lang") == "en", 1)).alias("gold"))


@_query("neighbour_range", f"""WITH {_SENT}, hit AS (SELECT doc_id, ordinal FROM sent WHERE contains(lower(content), 'harbour'))
    SELECT h.doc_id, CAST(h.ordinal AS INTEGER) AS centre, CAST(u.ordinal AS INTEGER) AS ordinal, u.content FROM hit h JOIN sent u ON u.doc_id = h.doc_id AND u.ordinal BETWEEN h.ordinal - 2 AND h.ordinal + 2""")
def _(s, d):
    c = split_units(documents(s, d), "sentence")
    hits = search(c, 'SELECT SENTENCE WHERE content CONTAINS "harbour"', "doc_id", "ordinal")
    return neighbours(hits, c.units, 2)


# without SQL: rows only


@_query("hash_embedding_search")
def _(s, d):
    c = split_units(documents(s, d), "sentence")
    e = HashEmbedder(DIM)
    units = c.units.withColumn("v", embed_column(F.col("content"), e))
    v = Collection(units, "sentence", c.fields, None, {"default": "v"}, c.documents)
    return search(v, 'SELECT SPAN(SENTENCE, 1) LET rel = SIMILARITY(content, "the tool agent checks the filter mask") WHERE rel > 0.3 ORDER BY rel DESC LIMIT 20', "unit_id", "content", "rel", embedder=e)


def _values(rows: list[tuple[str, str]], *names: str) -> str:
    quoted = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {quoted}) t({', '.join(names)})"


# The forms that other systems take of one filter.
_TRANSLATED = [
    ('must', "{'must': [{'key': 'status', 'match': {'value': 'published'}}, {'should': [{'key': 'year', 'range': {'gte': 2024}}, {'must_not': [{'must_not': [{'key': 'lang', 'match': {'value': 'en'}}]}]}]}]}"),
    ('where', "{'$and': [{'status': {'$eq': 'published'}}, {'$or': [{'year': {'$gte': 2024}}, {'lang': {'$eq': 'en'}}]}]}"),
    ('sql', "(metadata->>'status' = %s AND ((metadata->>'year')::numeric >= %s OR NOT (metadata->>'lang' <> %s))) ['published', 2024, 'en']"),
]


@_query("translated_filters", _values(_TRANSLATED, "target", "filter"))
def _(s, d):
    where = parse('SELECT CHUNK WHERE meta.status == "published" AND (meta.year >= 2024 OR NOT meta.lang != "en")').where
    sql, values = translate.sql_filter(where)
    return s.createDataFrame([("must", str(translate.must_filter(where))), ("where", str(translate.where_filter(where))), ("sql", f"{sql} {values}")], "target string, filter string")


# What is said of one query before it runs.
_EXPLAINED = [
    ('ir', "{'select': {'unit': 'document'}, 'where': {'node': 'and', 'operands': [{'node': 'compare', 'op': '==', 'left': {'node': 'path', 'root': 'meta', 'segments': ['lang']}, 'right': {'node': 'literal', 'value': 'en'}}, {'node': 'call', 'name': 'CONTAINS', 'args': [{'node': 'path', 'root': 'content', 'segments': []}, {'node': 'literal', 'value': 'agent'}]}]}, 'order_by': [{'expr': {'node': 'call', 'name': 'LENGTH', 'args': [{'node': 'path', 'root': 'content', 'segments': []}]}, 'desc': True}], 'limit': 5}"),
    ('select', "{'unit': 'document', 'window': None}"),
    ('granularity', 'document'),
    ('store', 'local'),
    ('scores', '[]'),
    ('bindings', '[]'),
    ('filter', "{'pushed': {'node': 'compare', 'op': '==', 'left': {'node': 'path', 'root': 'meta', 'segments': ['lang']}, 'right': {'node': 'literal', 'value': 'en'}}, 'residual': {'node': 'call', 'name': 'CONTAINS', 'args': [{'node': 'path', 'root': 'content', 'segments': []}, {'node': 'literal', 'value': 'agent'}]}}"),
    ('order_by', "[{'expr': {'node': 'call', 'name': 'LENGTH', 'args': [{'node': 'path', 'root': 'content', 'segments': []}]}, 'desc': True}]"),
    ('limit', '5'),
    ('recall', 'scan'),
]


@_query("explain_plan", _values(_EXPLAINED, "item", "value"))
def _(s, d):
    e = Engine(s, documents(s, d))
    x = e.explain('SELECT DOCUMENT WHERE meta.lang == "en" AND content CONTAINS "agent" ORDER BY LENGTH(content) DESC LIMIT 5')
    return s.createDataFrame([(k, str(v)) for k, v in x.items()], "item string, value string")


# Which conditions each layout holds itself.
_PUSHED = [
    ('local', 'compare', 'call'),
    ('faiss', '', 'and'),
    ('hnsw', 'compare', 'call'),
    ('qdrant', 'compare', 'call'),
    ('chroma', 'compare', 'call'),
    ('pgvector', 'and', ''),
]


@_query("layout_pushdown", _values(_PUSHED, "layout", "pushed", "residual"))
def _(s, d):
    shown = lambda n: "" if n is None else str(n)
    rows = []
    for name, profile in PROFILES.items():
        x = Engine(s, replace(documents(s, d), profile=profile)).explain('SELECT DOCUMENT WHERE meta.lang == "en" AND content CONTAINS "agent"')["filter"]
        rows.append((name, shown(x["pushed"] and x["pushed"]["node"]), shown(x["residual"] and x["residual"]["node"])))
    return s.createDataFrame(rows, "layout string, pushed string, residual string")


# The nodes of the query schema, and the tool's outline.
_SCHEMA = [
    ('nodes', 'and binding call compare expr literal not or orderKey path ref select'),
    ('functions', 'CONTAINS COUNT LENGTH LIKE LOWER MATCH SIMILARITY UPPER'),
    ('tool', 'function type'),
    ('same', 'True'),
]


@_query("query_schema", _values(_SCHEMA, "item", "value"))
def _(s, d):
    e = Engine(s, documents(s, d))
    t = e.tool()
    rows = [("nodes", " ".join(sorted(e.schema()["$defs"]))), ("functions", " ".join(e.registry.names("function"))), ("tool", " ".join(sorted(t))), ("same", str(schema.query_schema(e.registry.names("function")) == e.schema()))]
    return s.createDataFrame(rows, "item string, value string")


@_query("cell_index_topk", f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_cos('a.embedding', 'b.embedding')} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
    SELECT query_id, vec_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM p QUALIFY rank <= 10""")
def _(s, d):
    e = table(s, d, "embeddings")
    index = vectors.CellIndex.build(e, "embedding", f"{workspace(s)}/cells", cells=16)
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return index.batch_search(s, "vec_id", q, 10, probes=8).withColumn("score", F.round("score", 6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meaning, metadata and keywords in one query over sentences embedded on the fly."""
    docs = documents(spark, sf_dir)
    e = HashEmbedder(DIM)
    c = split_units(docs, "sentence")
    units = c.units.withColumn("v", embed_column(F.col("content"), e))
    v = Collection(units, "sentence", c.fields, None, {"default": "v"}, c.documents)
    q = select("sentence").let("rel", similarity("content", "the harbour guide checks the index")).where(meta("lang") == "en", contains(content, "harbour"), ref("rel") > 0.2).order_by("rel", desc=True).limit(20)
    return search(v, q, "unit_id", "doc_id", "content", "rel", embedder=e)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
