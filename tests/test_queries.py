"""Every core query against its SQL."""

import pytest

from helpers import DATA, same
from quire.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    same(catalogue.QUERIES[name](spark, f"{DATA}/sf0.001"), duck("sf0.001").sql(catalogue.ORACLES[name]))


def test_all_have_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_known_counts(spark):
    d = f"{DATA}/sf0.01"
    assert catalogue.QUERIES["q_chunk_documents"](spark, d).count() == 4053
    assert catalogue.QUERIES["q_chunk_conversations_cross_small"](spark, d).count() == 3834


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scan_reads_only_what_it_needs(spark):
    plan = catalogue.QUERIES["q_files_by_content"](spark, f"{DATA}/sf0.01")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<text:string>" in plan
