"""Every registered query against its SQL on the smallest driver tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        ok, message = compare(df, con, ORACLES[name])
        assert ok, message
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {(r["order"], r["split"]) for r in rows} >= {("detector", "overall"), ("fused", "overall")}


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
