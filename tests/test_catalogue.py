"""Every registered query of the engine against its SQL on the smallest data."""

import glob
import os

import duckdb
import pytest

from quillspan.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, data, con, name):
    df = catalogue.queries()[name](spark, data)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        cur = con.execute(SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, cur.fetchall())
    assert got


def test_flagship(spark, data):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalogue.flagship(spark, data).columns == ["unit_id", "doc_id", "content", "rel"]
