"""The registered queries: names, and results of those that SQL can state."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from check import TABLES, canonical
from tickloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    result = db.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), names)


@pytest.mark.parametrize("name,columns", [
    ("op2_token_counts", ["doc_id", "n_bytes", "n_tokens", "over_limit"]),
    ("op5_personal_data", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]),
    ("op10_near_dedup", ["doc_id", "n_shingles", "component_id", "kept"])])
def test_one_row_per_document(spark, name, columns):
    df = queries()[name](spark, SF)
    assert df.columns == columns and df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
