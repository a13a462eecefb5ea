"""Queries against SQL, on the small tables and on the generated ones, and on empty tables."""

import pytest

from helpers import DATA, same
from quire.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, f"{DATA}/sf0.001"), duck("sf0.001").sql(queries.ORACLES[name]))


@pytest.mark.parametrize("name", ["op5_mix", "op7_line_dedup"])
def test_sql_on_odd_texts(spark, small, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small[0]}/documents.parquet/*.parquet'")
    same(queries.QUERIES[name](spark, small[0]), con.sql(queries.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, nothing, name):
    assert queries.QUERIES[name](spark, nothing).count() == 0
