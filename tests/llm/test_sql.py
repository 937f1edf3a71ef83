"""The queries with SQL give DuckDB's rows on the smallest tables."""

import os

import pytest

from corpusloom.llm import queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{SF}/{table}'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(r) for r in found.fetchall())
