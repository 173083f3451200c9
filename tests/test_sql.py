"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Every query with SQL; those of the training-data operators have tests of their own.
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))


def plain(rows, columns):
    norm = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")
@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    r = tables.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(r.fetchall(), columns)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
