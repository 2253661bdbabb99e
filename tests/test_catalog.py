"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_point
from bandwalk.catalog import REGISTRY
from tools.compare import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {name: e.run for name, e in REGISTRY.items()}
SQL = {name: e.sql for name, e in REGISTRY.items() if e.sql is not None}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() == 5


def test_registry_is_consistent():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(SQL) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    verdict = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert verdict.startswith(("ok", "rows")), verdict
    assert "TYPES" not in verdict, verdict
