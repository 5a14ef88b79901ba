"""Every registered query against its SQL; QUERIES=name,name runs some of them."""

import os

import pytest

import __spark_entry__ as entry
from assetweave.plans import catalog
from compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = [n for n in catalog.queries() if n in os.environ.get("QUERIES", n).split(",")]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    df, sql = entry.queries()[name](spark, SF_DIR), entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        assert compare(df, connect(SF_DIR), sql) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
