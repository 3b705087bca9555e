"""Every registered query equals its SQL oracle on the smallest tables."""

import pytest
from oracle_tool import compare, connect

import __spark_entry__ as entry
from vaxframe.plans import catalog

SF = "/root/testdata/sf0.001"
catalog.load()  # the corpus queries, some of which have no SQL form, are tested in tests/llm
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problems, _, _, _ = compare(spark, name, QUERIES[name], ORACLES[name], SF, con)
    assert not problems, problems
