"""Every registered query against its DuckDB text, on the smallest data set."""

import os

import compare
import pytest

import __spark_entry__ as entry_point
from factfade.plans import all_oracles, all_queries

SF = os.environ.get("FACTFADE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="session")
def con():
    return compare.duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_point_has_them_all():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLES) <= set(entry_point.oracle_sql())


def test_entry(spark):
    assert entry_point.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = compare.spark_rows(QUERIES[name](spark, SF))
    assert compare.difference(got, compare.duck_rows(con, ORACLES[name])) is None
