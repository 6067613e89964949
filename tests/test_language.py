"""Front ends: string, builder and JSON give one immutable form."""

import pytest

from quillspan.builder import content, contains, field, fn, length, meta, ref, select, similarity
from quillspan.errors import ParseError, PlanError, SchemaError
from quillspan.functions import builtins as _  # noqa: F401
from quillspan.functions.registry import GLOBAL
from quillspan.plans.analyze import PROFILES, analyze, split
from quillspan.plans.ir import And, Call, Compare, Literal, Not, Or, Path, Query, Ref, Select
from quillspan.plans.parse import parse
from quillspan.plans.schema import query_schema, tool


def test_whole_query():
    q = parse('SELECT SPAN(SENTENCE, window => 2) LET rel = SIMILARITY(content, "x") WHERE rel >= 0.5 AND meta.status != \'draft\' ORDER BY rel DESC, meta.year LIMIT 3')
    assert q.select == Select("sentence", 2)
    assert q.let == (("rel", Call("SIMILARITY", (Path("content"), Literal("x")))),)
    assert q.where == And((Compare(">=", Ref("rel"), Literal(0.5)), Compare("!=", Path("meta", ("status",)), Literal("draft"))))
    assert [k.desc for k in q.order_by] == [True, False] and q.limit == 3
    assert Query.from_json(q.to_json()) == q


def test_precedence():
    w = parse("SELECT CHUNK WHERE NOT a == 1 AND b == 2 OR c").where
    assert w == Or((And((Not(Compare("==", Path("a"), Literal(1))), Compare("==", Path("b"), Literal(2)))), Path("c")))
    assert parse("SELECT CHUNK WHERE NOT NOT a").where == Not(Not(Path("a")))
    assert parse('SELECT CHUNK WHERE title CONTAINS "x" == true').where == Compare("==", Call("CONTAINS", (Path("title"), Literal("x"))), Literal(True))
    assert parse("SELECT CHUNK WHERE (a OR b) AND c").where == And((Or((Path("a"), Path("b"))), Path("c")))
    assert len(parse("SELECT CHUNK WHERE a AND b AND c").where.operands) == 3


@pytest.mark.parametrize(
    ("text", "value"),
    [("1", 1), ("-2", -2), ("0.5", 0.5), ("true", True), ("null", None), ('"a\'b"', "a'b"), ("'q'", "q")],
)
def test_literals(text, value):
    assert parse(f"SELECT CHUNK WHERE a == {text}").where.right == Literal(value)


def test_words_that_begin_like_constants_are_names():
    assert parse("SELECT CHUNK WHERE nullable == trueish").where == Compare("==", Path("nullable"), Path("trueish"))
    assert parse("SELECT CHUNK WHERE meta.true == meta.null").where == Compare("==", Path("meta", ("true",)), Path("meta", ("null",)))


def test_typed_literal():
    assert parse('SELECT CHUNK WHERE d >= DATE "2024-01-01"').where.right == Literal("2024-01-01", "date")
    assert parse('SELECT CHUNK WHERE d == EMAIL "x"').where.right == Literal("x", "email")


def test_span_default_and_positional():
    assert parse("SELECT SPAN(CHUNK)").select == Select("chunk", 1)
    assert parse("SELECT SPAN(CHUNK, 0)").select == Select("chunk", 0)


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT PAGE", "SELECT CHUNK WHERE", "SELECT CHUNK LIMIT 1.5", "SELECT CHUNK LIMIT -1", "SELECT CHUNK WHERE a == 1 == 2", "SELECT CHUNK extra", "SELECT CHUNK WHERE a ~ 1", "SELECT SPAN(CHUNK, -1)", "SELECT CHUNK WHERE SELECT", "SELECT CHUNK LET a = 1, a = 2"])
def test_syntax_errors(text):
    with pytest.raises(ParseError):
        parse(text)


def test_error_position():
    with pytest.raises(ParseError) as e:
        parse("SELECT CHUNK\nWHERE a = 1")
    assert (e.value.line, e.value.column) == (2, 9) and "WHERE a = 1" in e.value.context


def test_front_ends_agree():
    text = parse('SELECT SENTENCE LET rel = SIMILARITY(content, "q") WHERE rel >= 0.8 AND meta.status != "draft" ORDER BY rel DESC LIMIT 5')
    built = select("sentence").let("rel", similarity("content", "q")).where(ref("rel") >= 0.8, meta("status") != "draft").order_by("rel", desc=True).limit(5).build()
    assert built == text == Query.from_dict(text.to_dict())


def test_builder_operators():
    e = (field("a") > 1) & (meta("b") == "x") & contains(content, "y") | ~(length(content) < 3)
    assert isinstance(e.node, Or) and len(e.node.operands[0].operands) == 3
    assert fn("LOWER", content).like("a%").node == Call("LIKE", (Call("LOWER", (Path("content"),)), Literal("a%")))
    with pytest.raises(TypeError):
        hash(content)
    with pytest.raises(TypeError):
        bool(content == 1)
    first = select("chunk")
    first.limit(3)
    assert first.build().limit is None


@pytest.mark.parametrize("d", [{}, {"select": {"unit": "page"}}, {"select": {"unit": "chunk", "window": -1}}, {"select": {"unit": "chunk"}, "where": {"node": "nope"}}, {"select": {"unit": "chunk"}, "where": {"node": "compare", "op": "~", "left": {"node": "literal", "value": 1}, "right": {"node": "literal", "value": 1}}}, {"select": {"unit": "chunk"}, "limit": -1}, {"select": {"unit": "chunk"}, "extra": 1}, {"select": {"unit": "chunk"}, "where": {"node": "path"}}, []])
def test_malformed_documents(d):
    with pytest.raises(SchemaError):
        Query.from_dict(d)


def test_json_schema_names_functions():
    s = query_schema(["LENGTH", "COUNT"])
    assert s["$defs"]["call"]["properties"]["name"]["enum"] == ["COUNT", "LENGTH"]
    assert s["required"] == ["select"] and s["properties"]["limit"]["minimum"] == 0
    assert {r["$ref"].rsplit("/", 1)[1] for r in s["$defs"]["expr"]["oneOf"]} == {"literal", "path", "ref", "call", "compare", "and", "or", "not"}
    assert tool(["LENGTH"])["function"]["parameters"]["title"]


def check(text, **how):
    return analyze(parse(text), GLOBAL, **how)


@pytest.mark.parametrize("text", ['SELECT CHUNK WHERE NOPE(content)', "SELECT CHUNK WHERE LENGTH(content, 1) > 2", "SELECT CHUNK LET a = b, b = a WHERE a > 1", "SELECT CHUNK LET a = a", "SELECT CHUNK WHERE SIMILARITY(content, meta.q) > 0", 'SELECT CHUNK WHERE SIMILARITY(LOWER(content), "q") > 0', 'SELECT CHUNK WHERE SIMILARITY(title, "q") > 0'])
def test_plan_errors(text):
    with pytest.raises(PlanError):
        check(text)


def test_unknown_reference_from_json():
    q = Query(Select("chunk"), where=Ref("x"))
    with pytest.raises(PlanError):
        analyze(q, GLOBAL)


def test_scorers_are_shared():
    a = check('SELECT CHUNK LET r = SIMILARITY(content, "q") WHERE similarity(content, "q") > 0.1 ORDER BY SIMILARITY(vec.image, "q") DESC')
    assert [(s.vector, s.text) for s in a.scorers.values()] == [("default", "q"), ("image", "q")]


def test_pushdown_split():
    local, sql, faiss = PROFILES["local"], PROFILES["pgvector"], PROFILES["faiss"]
    w = parse('SELECT CHUNK WHERE a == "x" AND b > 3 AND c > "y" AND content CONTAINS "k" AND d == null AND e == DATE "2024-01-01"').where
    pushed, rest = split(w, local, {})
    assert len(pushed.operands) == 2 and len(rest.operands) == 4
    assert len(split(w, sql, {})[0].operands) == 3
    assert split(w, faiss, {})[0] is None
    assert len(split(w, local, {"a": "text"})[1].operands) == 5
    o = parse('SELECT CHUNK WHERE a == 1 OR LENGTH(content) > 3').where
    assert split(o, local, {}) == (None, o)
