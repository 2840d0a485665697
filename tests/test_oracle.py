"""Every query with a SQL twin, compared on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry

from .oracle import ROOT, compare, connect

SF_DIR = f"{ROOT}/sf{os.environ.get('ORACLE_SF', '0.001')}"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 1
