"""Every plan-sheet query against its SQL on the driver's smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from terracut.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows, columns):
    value = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(value(r[c]) for c in columns) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    result = db.execute(SQL[name])
    names = [d[0] for d in result.description]
    want = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
    columns = sorted(got.columns)
    assert columns == sorted(names)
    assert plain([r.asDict() for r in got.collect()], columns) == plain(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["elevation_context", "associations", "redundant_polylines"])
def test_spatial_joins_are_equi_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
