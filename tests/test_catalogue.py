"""Every query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from biblioscope.plans import catalogue
from tests.oracle import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, entry.queries()[name], entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.collect() is not None and len(df.columns) == len(set(df.columns))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
