"""Comparison rules: Columns against the same rules on Python values, over random strings."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.engine import Engine
from quillspan.errors import PlanError, TypeMismatch
from quillspan.functions.registry import Registry, Signature
from quillspan.functions.types import TypeHandler, date_column, date_of, number_column, number_of
from quillspan.plans.compile import interpret
from quillspan.sources.collection import Collection, of_table

STRINGS = ["007", "7", "7.0", " 7", "7 ", "1_000", "5d", "+inf", "-infinity", "nan", "1e3", ".5", "5.", "", "abc", "2024", "2024-01", "2024-3-1", "2024-06-01", "20240601", "2024-06-01T10", "2024-06-01 10:00", "2024-06-01T10:00:00.123", "true", "True", "%", "_", "Zebra", "2024-02-30", "99999999"]


def table(spark):
    rows = [(i, s, float(i), i % 3 == 0) for i, s in enumerate([*STRINGS, None])]
    df = spark.createDataFrame(rows, "id long, s string, n double, b boolean")
    return of_table(df.withColumn("v", F.when(F.col("id") % 2 == 0, F.parse_json(F.to_json(F.struct("s", "n", "b")))).otherwise(F.parse_json(F.lit("{}")))), "id", "s", ["s", "n", "b", "v"])


def ids(df):
    return sorted(int(r.unit_id) for r in df.select("unit_id").collect())


@pytest.fixture(scope="module")
def coll(spark):
    c = table(spark)
    return c.with_units(c.units.cache())


def test_guards_match_python(spark):
    rng = random.Random(3)
    words = STRINGS + ["".join(rng.choice("0123456789+-._eE T:x") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    for r in df.select("s", number_column(F.col("s")).alias("n"), date_column(F.col("s")).alias("d")).collect():
        want = number_of(r.s)
        assert r.n == want or (want != want), r
        assert r.d == date_of(r.s), r


@pytest.mark.parametrize("literal", ['"7"', '"2024-06-01"', '"abc"', '"Zebra"', 'TEXT "7"', 'NUMBER "7"', 'DATE "2024-06-01"', '"20240601"', '"5d"'])
@pytest.mark.parametrize("op", ["==", "!=", "<", ">="])
def test_string_comparisons(spark, coll, literal, op):
    hint, value = literal.split(" ")[0].lower() if " " in literal else None, literal.split('"')[1]
    got = ids(Engine(spark, coll).search(f"SELECT DOCUMENT WHERE meta.s {op} {literal}"))
    want = sorted(i for i, s in enumerate([*STRINGS, None]) if interpret(op, s, value, hint))
    assert got == want


def test_number_against_string_field(spark, coll):
    got = ids(Engine(spark, coll).search("SELECT DOCUMENT WHERE meta.s == 7"))
    assert got == [i for i, s in enumerate([*STRINGS, None]) if interpret("==", s, 7)]
    loose = ids(Engine(spark, coll, strict=False).search("SELECT DOCUMENT WHERE meta.s > 6"))
    assert 0 in loose and STRINGS.index("abc") not in loose
    with pytest.raises(Exception, match="can't compare"):
        Engine(spark, coll).search("SELECT DOCUMENT WHERE meta.s > 6").collect()


def test_two_valued_logic(spark, coll):
    e, last = Engine(spark, coll), len(STRINGS)
    assert last in ids(e.search('SELECT DOCUMENT WHERE NOT meta.s > "a"'))
    assert last not in ids(e.search('SELECT DOCUMENT WHERE meta.s > "a"'))
    assert ids(e.search("SELECT DOCUMENT WHERE meta.s == null")) == [last]
    assert last not in ids(e.search("SELECT DOCUMENT WHERE meta.s != null"))
    assert last in ids(e.search('SELECT DOCUMENT WHERE meta.s != "x"'))
    assert len(ids(e.search("SELECT DOCUMENT WHERE meta.nowhere == null"))) == last + 1
    assert ids(e.search("SELECT DOCUMENT WHERE meta.nowhere > 3 OR null")) == []


def test_booleans_and_truth(spark, coll):
    e = Engine(spark, coll)
    assert ids(e.search("SELECT DOCUMENT WHERE meta.b == true")) == ids(e.search("SELECT DOCUMENT WHERE meta.b == 1")) == ids(e.search("SELECT DOCUMENT WHERE b"))
    assert 0 not in ids(e.search("SELECT DOCUMENT WHERE meta.n"))
    assert STRINGS.index("") not in ids(e.search("SELECT DOCUMENT WHERE meta.s"))


def test_statically_wrong(spark, coll):
    with pytest.raises(TypeMismatch):
        Engine(spark, coll).search('SELECT DOCUMENT WHERE meta.n > "abc"')


def test_variant_fields(spark, coll):
    e = Engine(spark, coll, strict=False)
    even = [(i, s) for i, s in enumerate([*STRINGS, None]) if i % 2 == 0]
    assert ids(e.search("SELECT DOCUMENT WHERE meta.v.n >= 10")) == [i for i, _ in even if i >= 10]
    assert ids(e.search("SELECT DOCUMENT WHERE meta.v.s == 7")) == [i for i, s in even if interpret("==", s, 7)]
    assert ids(e.search('SELECT DOCUMENT WHERE meta.v.s == "abc"')) == [i for i, s in even if s == "abc"]
    assert ids(e.search("SELECT DOCUMENT WHERE meta.v.b")) == [i for i, _ in even if i % 3 == 0]


def test_text_functions(spark, coll):
    e = Engine(spark, coll)
    assert ids(e.search('SELECT DOCUMENT WHERE LIKE(content, "%")')) == list(range(len(STRINGS)))
    assert ids(e.search('SELECT DOCUMENT WHERE content LIKE "_"')) == [i for i, s in enumerate(STRINGS) if len(s) == 1]
    assert ids(e.search('SELECT DOCUMENT WHERE content MATCH "^(?P<y>20)24-"')) == [i for i, s in enumerate(STRINGS) if s.startswith("2024-")]
    assert ids(e.search('SELECT DOCUMENT WHERE CONTAINS(content, "ZEB")')) == [STRINGS.index("Zebra")]
    r = e.search('SELECT DOCUMENT LET c = COUNT(content, "0"), z = COUNT(content, "") WHERE content == TEXT "1_000"').first()
    assert (r.c, r.z) == (3, 0)
    with pytest.raises(PlanError):
        e.search('SELECT DOCUMENT WHERE content MATCH "(?(1)a|b)"')


def test_order_of_mixed_strings(spark, coll):
    got = [r.content for r in Engine(spark, coll).search("SELECT DOCUMENT ORDER BY meta.s").collect()]
    assert got[-1] is None and got[0] == "2024-06-01" and got[1] == "20240601"
    down = [r.content for r in Engine(spark, coll).search("SELECT DOCUMENT ORDER BY meta.s DESC").collect()]
    assert down[0] is None
    num = [r.content for r in Engine(spark, coll, field_types={"s": "number"}).search("SELECT DOCUMENT ORDER BY meta.s LIMIT 3").collect()]
    assert num[0] == "-infinity"


def test_typed_comparisons_reach_the_scan(spark, data):
    c = of_table(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text", ["lang", "n_chars"])
    plan = Engine(spark, c).search('SELECT DOCUMENT WHERE meta.lang == "en" AND n_chars >= 100 AND n_chars < 900.5').select("unit_id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualNullSafe(lang,en)" in pushed and "GreaterThanOrEqual(n_chars,100)" in pushed and "LessThanOrEqual(n_chars,900)" in pushed
    assert "text" not in plan.split("ReadSchema: ")[1].split("\n")[0]


def test_custom_functions_and_types(spark, coll):
    e = Engine(spark, coll, registry=Registry(Engine(spark, coll).registry))
    e.register_function("TWICE", Signature(("any",), "double"), build=lambda x: x * 2)

    @e.register_function("ODD", Signature(("text",), "bool"))
    def odd(t):
        return bool(t) and len(t) % 2 == 1

    assert ids(e.search("SELECT DOCUMENT WHERE TWICE(meta.n) == 14")) == [7]
    assert ids(e.search("SELECT DOCUMENT WHERE ODD(content)")) == [i for i, s in enumerate(STRINGS) if len(s) % 2]
    e.register_type("size", TypeHandler("size", len, compare=lambda a, b, op: (a == b) if op == "==" else a < b))
    assert ids(e.search('SELECT DOCUMENT WHERE meta.s == SIZE "xyz"')) == [i for i, s in enumerate(STRINGS) if len(s) == 3]

    @e.register_type("rev")
    class Rev:
        def parse(self, s):
            return s[::-1]

    assert ids(e.search('SELECT DOCUMENT WHERE meta.s == REV "abc"')) == [STRINGS.index("abc")]
    with pytest.raises(Exception, match="already"):
        e.register_function("TWICE", build=lambda x: x)


def test_collection_lacks_columns(spark):
    with pytest.raises(Exception, match="lack"):
        Collection(spark.range(1))
