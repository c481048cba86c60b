"""Every registered query against its oracle SQL on the smallest scale."""

import os

import pytest
from compare import check, connect

from __spark_entry__ import entry
from outlay.catalog import all_oracles, all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).columns[0] == "service"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problems, _ = check(QUERIES[name](spark, SF_DIR), ORACLES[name], con)
    assert not problems
