"""Every registered query with SQL against DuckDB on the same files."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as registered

SQL = registered.oracle_sql()
QUERIES = registered.queries()


@pytest.fixture(scope="module")
def duck(medium):
    con = duckdb.connect()
    for path in glob.glob(f"{medium}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(repr(tuple(r[i] for i in order)) for r in rows)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN"}


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, duck, medium):
    df = QUERIES[name](spark, medium)
    cursor = duck.execute(SQL[name])
    expected = canonical([c[0] for c in cursor.description], cursor.fetchall())
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in ("EvalPython", "NestedLoop", "Cartesian") if bad in plan]
    assert got[0] == expected[0]
    assert {c: TYPES[t] for c, t in df.dtypes} == {c[0]: str(c[1]) for c in cursor.description}
    assert len(got[1]) == len(expected[1])
    differing = [(g, e) for g, e in zip(got[1], expected[1]) if g != e]
    assert not differing, f"{len(differing)} rows differ, first: {differing[0]}"
