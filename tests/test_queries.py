"""Every query against its SQL at the smallest size."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from sparkmask.operators import queries as reference
from tests.conftest import DATA, needs_data

TABLES = reference.TABLES


def cell(v):
    if v is None or v != v:
        return "NULL"
    return repr(float(v)) if isinstance(v, float) else str(v)


def compare(spark, name, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = query(spark, DATA)
    columns = sorted(df.columns)
    rel = con.sql(sql)
    assert columns == sorted(rel.columns), name
    order = [rel.columns.index(c) for c in columns]
    ours = sorted([tuple(cell(r[c]) for c in columns) for r in df.collect()])
    theirs = sorted([tuple(cell(r[i]) for i in order) for r in rel.fetchall()])
    assert ours == theirs, name


@needs_data
@pytest.mark.parametrize("name", sorted(reference.QUERIES))
def test_query(spark, name):
    compare(spark, name, reference.QUERIES[name], reference.ORACLE_SQL[name])


@needs_data
def test_entry(spark):
    found = {r["pattern"]: (r["before"], r["after"]) for r in entry_point.entry(spark).collect()}
    assert found["email"] == (5, 0) and found["phone-parens"] == (5, 0) and len(found) == 5


def test_names_of_queries():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(reference.QUERIES) <= set(entry_point.queries())


def test_a_missing_package_leaves_the_other_queries(monkeypatch):
    import sys

    for name in [n for n in sys.modules if n.startswith("sparkmask.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sparkmask.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    with pytest.warns(UserWarning, match="no queries for training data"):
        assert set(entry_point.queries()) == set(reference.QUERIES)
