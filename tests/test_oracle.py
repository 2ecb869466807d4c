"""Every registered query against its SQL, over the whole small tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from srcstrata.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries()) & set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    assert difference(spark, con, FOLDER, name) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
