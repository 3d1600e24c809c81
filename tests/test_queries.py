"""Every registered query against its DuckDB statement, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check_oracles
from wardlake.plans import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_oracles.connect(SF_DIR)


def test_every_query_has_a_statement():
    assert set(registry.oracles()) == set(registry.QUERIES)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    equal, note = check_oracles.compare(spark, con, name, SF_DIR)
    assert equal, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
