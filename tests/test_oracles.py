"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle_check import contract, mismatch, open_tables

from tripweave.queries.catalog import QUERIES
from tripweave.queries.oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return open_tables(sf_dir)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= contract.queries().keys() and ORACLES.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, sf_dir, name):
    assert mismatch(spark, con, sf_dir, name) is None


def test_entry(spark):
    assert contract.entry(spark).columns == ["src", "dst", "normal", "transfer_prob"]
