"""The driver contract: every planning query runs, and agrees with its SQL."""

import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from parcelwise.plans import queries as planning

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(planning.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = planning.queries()[name](spark, SF)
    rows = db.execute(planning.oracle_sql()[name])
    columns = [c[0] for c in rows.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(rows.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(planning.queries()) - set(planning.oracle_sql())))
def test_query_without_sql(spark, name):
    assert planning.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_names():
    found = entry.queries()
    assert set(planning.queries()) <= set(found) and set(entry.oracle_sql()) <= set(found)


def test_without_the_optional_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "parcelwise.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    module = importlib.reload(entry)
    assert set(module.queries()) == set(planning.queries())
    monkeypatch.undo()
    importlib.reload(entry)
