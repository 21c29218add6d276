"""Every registered query of the library against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from wayfold.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SF}/{name}'")
    return connection


def rows(frame, columns):
    return sorted(repr([round(x, 9) if isinstance(x, float) else str(x) for x in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    want, got = db.sql(catalog.ORACLES[name]).df(), catalog.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def test_route_points_follow_edges(spark):
    """Each hop of a way is an edge, and its cost is what the relaxation says."""
    found = catalog._costs(spark, SF)
    arcs = {(r.src, r.dst): r.cost for r in catalog._arcs(spark, SF).collect()}
    cost = {(r.origin, r.node): r.cost for r in found.collect()}
    ways: dict = {}
    for r in catalog.route_points(spark, SF).collect():
        ways.setdefault((r.origin, r.target), {})[r.hop] = r.node
    assert ways
    for (origin, target), nodes in ways.items():
        path = [nodes[k] for k in sorted(nodes, reverse=True)]
        total = sum(arcs[a, b] for a, b in zip(path, path[1:], strict=False))
        assert path[-1] == target and total + cost[origin, path[0]] == cost[origin, target]


def test_plans_push_down_and_prune(spark):
    plan = catalog.QUERIES["missing_regions"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<n_nationkey:int>" in plan and "PushedFilters" in plan
    for name in ("trip_stats", "edge_costs_by_profile", "mask_closing", "snap_segment"):
        text = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "Python" not in text and "CartesianProduct" not in text
