"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest
from check_queries import compare, open_oracle

from __spark_entry__ import entry, oracle_sql, queries
from martwright.registry.catalog import CATALOG

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="benchmark tables not present")


@pytest.fixture(scope="module")
def oracle():
    return open_oracle(FOLDER)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_matches_sql(spark, oracle, name):
    problem, _, _ = compare(spark, oracle, FOLDER, name)
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(CATALOG) <= set(oracle_sql()) <= set(queries())
    assert all(CATALOG[name].sql for name in CATALOG)


def test_entry_returns_rows(spark):
    assert entry(spark).count() == 10
