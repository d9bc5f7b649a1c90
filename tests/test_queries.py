"""Every registered query against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from evledger.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, sql, name):
    result = entry.queries()[name](spark, DATA)
    columns = sorted(result.columns)
    got = sorted(([r[c] for c in columns] for r in result.collect()), key=repr)
    relation = sql.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    assert got == sorted(([r[i] for i in order] for r in relation.fetchall()), key=repr)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.valid for r in rows)
