"""The corpus queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from larkspur.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in rel.columns) for r in df.collect()) == sorted(rel.fetchall())


def test_digest_queries_give_one_row_per_row(spark):
    for name, f in queries.QUERIES.items():
        if name not in queries.ORACLES and name != "op3_packing_swap_search":
            table = "embeddings" if "embedding" in name else "documents"
            assert f(spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
