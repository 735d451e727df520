"""Every registered query against DuckDB, at the smallest scale."""

import pytest

import __spark_entry__ as contract
from tests.compare import compare

SF_DIR = "/root/testdata/sf0.001"
SLOW = {"intent_train", "intent_score"}


@pytest.mark.parametrize("name", [n for n in contract.queries() if n not in SLOW])
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, name, contract.queries()[name], contract.oracle_sql().get(name), SF_DIR)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns[0] == "ticket_id"
