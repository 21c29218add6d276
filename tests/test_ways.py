"""Graphs from tagged ways, and points in bounded regions."""

from pyspark.sql import functions as F

from wayfold.operators import ways


def test_graph_from_ways(spark):
    rows = [
        (1, {"highway": "residential", "maxspeed": "30"}, [1, 2, 3]),
        (2, {"highway": "track", "oneway": "yes", "surface": "gravel"}, [3, 4]),
        (3, {"highway": "path"}, [1, 4]),
        (4, {"natural": "water"}, [1, 2, 3, 1]),
        (5, {"highway": "primary", "access": "private"}, [1, 4]),
    ]
    table = spark.createDataFrame(rows, "id long, tags map<string,string>, refs array<bigint>")
    nodes = spark.createDataFrame([(k, 500000000 + k * 10000, 30000000) for k in (1, 2, 3, 4)], "id long, lat_e7 long, lon_e7 long")
    got = ways.edges(table, nodes).collect()
    assert sorted((r.src, r.dst) for r in got) == [(1, 2), (2, 1), (2, 3), (3, 2), (3, 4)]
    assert tuple(ways.counters(table, nodes).collect()[0]) == (5, 2, 4, 4)
    assert {r.max_speed_kph for r in got if r.road_class == 7} == {30} and [r.flags for r in got if r.road_class == 10] == [4]
    assert ways.edges(table, nodes.filter("id <> 2")).count() == 1
    kinds = table.select("id", ways.area_kind(F.col("tags")).alias("k")).filter("k IS NOT NULL").collect()
    assert [(r.id, r.k) for r in kinds] == [(4, "water")]


def test_points_in_regions(spark, tmp_path):
    (tmp_path / "a.poly").write_text("alpha\n1\n  0.0 0.0\n  4.0 0.0\n  4.0 4.0\n  0.0 4.0\nEND\n!2\n  1.0 1.0\n  2.0 1.0\n  2.0 2.0\n  1.0 2.0\nEND\nEND\n")
    (tmp_path / "b.poly").write_text("beta\n1\n  3.0 3.0\n  6.0 3.0\n  6.0 6.0\n  3.0 6.0\nEND\nEND\n")
    rings = ways.read_poly(spark, str(tmp_path))
    assert rings.count() == 12 and rings.filter("hole").count() == 4
    points = spark.createDataFrame([(0, 0.5, 0.5), (1, 1.5, 1.5), (2, 3.5, 3.5), (3, 5.0, 5.0), (4, 9.0, 9.0)], "point_id long, x double, y double")
    assert {r.point_id: r.region for r in ways.regions_of(points, rings).collect()} == {0: "alpha", 2: "alpha", 3: "beta"}
