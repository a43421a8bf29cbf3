import duckdb
import pytest

from check import TABLES, canonical
from __spark_entry__ import entry, oracle_sql, queries
from tickloom.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["o_orderkey", "occurred_at", "price", "line"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = queries()[name](spark, SF)
    result = db.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), names)
