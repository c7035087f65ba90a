"""Every registered query against its SQL on the smallest given tables."""

import pytest
from compare import compare, connect
from conftest import SMALL

import __spark_entry__ as entry
from tenderflow.checks import CHECKS

QUERIES = {name: query for name, query in entry.queries().items() if name in CHECKS}
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(CHECKS) <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, connection):
    assert compare(QUERIES[name], ORACLE[name], spark, SMALL, connection)["problem"] is None


def test_flagship_row_count(spark):
    assert entry.entry(spark).count() == 165
