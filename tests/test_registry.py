"""Every registered query against its SQL twin, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from check import TABLES, compare

from varloom.registry import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    if name in ORACLES:
        problem, _ = compare(df, con, ORACLES[name])
        assert problem is None, problem
    else:
        assert df.count() >= 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


#: These write files when they are called.
WRITES = ("a1_", "a2_", "a3_", "a9_", "a13_", "s1_", "b11_dictionary", "b12_dictionary")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(WRITES)))
def test_no_cartesian_products(name, spark, sf):
    """No registered plan may hold a cross join."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    # a scalar subquery aside, a nested loop is a cross join
    assert "BroadcastNestedLoopJoin" not in plan
