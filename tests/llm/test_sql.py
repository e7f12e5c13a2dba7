"""Queries of the subpackage that SQL can express, over whole tables."""

import os

import duckdb
import pytest

from quillon.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(f"{data}/sf0.01"):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/sf0.01/{f}')")
    df = QUERIES[name](spark, f"{data}/sf0.01")
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, found.fetchall()))
