"""Every registered query against its SQL oracle on the smallest tables."""

import pytest
from conftest import SF_DIR

from __spark_entry__ import entry, oracle_sql, queries
from check import compare
from gavelstream.registry import ALL

QUERIES, ORACLE = {name: query for name, query in queries().items() if name in ALL}, oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, oracle_db, name):
    assert compare(oracle_db, QUERIES[name](spark, SF_DIR), ORACLE[name]) == ""


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ALL) <= set(ORACLE)


def test_entry(spark):
    assert entry(spark).columns == ["auction", "bid_count", "window_start", "window_end"]
