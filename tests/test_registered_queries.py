"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from billwright.plans.oracle import ORACLE
from billwright.plans.queries import QUERIES
from compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, problems = compare(spark, con, SF, QUERIES[name], ORACLE[name])
    assert not problems
    assert rows > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
