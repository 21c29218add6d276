"""Small graphs, places, tracks and masks with known answers."""

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo, roads, text
from wayfold.operators import graph, navigation, search, spatial, store, tiles, tracks


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).collect()[0]


def nodes_of(spark, places):
    return spark.createDataFrame([(k, round(a * 1e7), round(b * 1e7)) for k, (a, b) in enumerate(places)], "node_id long, lat_e7 long, lon_e7 long")


def test_geodesy(spark):
    r = one(
        spark,
        d=geo.haversine_m(F.lit(50.0), F.lit(3.0), F.lit(50.0), F.lit(3.01)), b=geo.bearing_deg(F.lit(50.0), F.lit(3.0), F.lit(51.0), F.lit(3.0)),
        t=geo.signed_turn_deg(F.lit(350.0), F.lit(10.0)), u=geo.signed_turn_deg(F.lit(10.0), F.lit(190.0)), h=geo.heading_difference_deg(F.lit(350.0), F.lit(10.0)),
        y=geo.mercator_y(F.lit(0.0)), x=geo.mercator_x(F.lit(180.0)), e=geo.to_e7(F.lit(-1.00000005)), v=geo.valid(F.lit(91.0), F.lit(0.0)),
    )
    assert r.d == pytest.approx(714.7, abs=1) and r.b == pytest.approx(0, abs=1e-9) and r.t == 20 and r.u == 180 and r.h == 20
    assert r.y == 0.5 and r.x == 0 and r.e == -10000001 and not r.v
    lat, lon = geo.destination(F.lit(50.0), F.lit(3.0), F.lit(90.0), F.lit(1000.0))
    assert one(spark, d=geo.haversine_m(F.lit(50.0), F.lit(3.0), lat, lon)).d == pytest.approx(1000, abs=1e-6)


def test_profiles_choose_roads(spark):
    """Motorway 2 x 1000 m at 100 km/h, or gravel track 2 x 1200 m at 50: the fast profile takes the first, the trail profile the second."""
    rows = [(0, 0, 1, 1, 0, 100, 100_000), (1, 1, 3, 1, 0, 100, 100_000), (2, 0, 2, 10, 4, 50, 120_000), (3, 2, 3, 10, 4, 50, 120_000)]
    edges = spark.createDataFrame(rows, "edge_id long, src long, dst long, road_class int, flags int, max_speed_kph int, length_cm long")
    start = spark.createDataFrame([(0, 0, 0)], "origin int, node long, cost long")
    for profile, middle in (("FASTEST", 1), ("TRAIL", 2)):
        rows = roads.edge_costs(edges).filter(F.col("profile") == profile).withColumn("ms", F.round(F.col("cost") * 1000).cast("long"))
        found = graph.shortest(graph.cheapest_arcs(rows, "ms"), start)
        way = graph.ways(found, spark.createDataFrame([(0, 3)], "origin int, node long"))
        assert [r.node for r in way.orderBy(F.desc("hop")).collect()] == [0, middle, 3]
    assert roads.edge_costs(edges.withColumn("flags", F.lit(1)), avoid_tolls=True).count() == 0


def test_one_way_and_disconnected(spark):
    arcs = spark.createDataFrame([(0, 1, 5), (2, 3, 1)], "src long, dst long, cost long")
    found = graph.shortest(arcs, spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 0, 7), (2, 2, 0)], "origin int, node long, cost long"))
    assert sorted((r.origin, r.node, r.cost) for r in found.collect()) == [(0, 1, 0), (1, 0, 0), (1, 1, 5), (2, 0, 7), (2, 1, 12), (2, 2, 0), (2, 3, 1)]
    assert graph.shortest(arcs.limit(0), found.select("origin", "node", "cost").limit(0)).count() == 0


def test_tags(spark):
    tags = F.create_map(F.lit("highway"), F.lit("primary_link"), F.lit("access"), F.lit("no"), F.lit("motor_vehicle"), F.lit("yes"), F.lit("junction"), F.lit("roundabout"))
    r = one(
        spark, c=roads.class_of_highway(tags["highway"]), d=roads.access_denied(tags), p=roads.motor_permitted(tags), w=roads.direction(tags),
        m=roads.max_speed_kph(F.lit("30 mph")), k=roads.max_speed_kph(F.lit("50")), z=roads.max_speed_kph(F.lit("walk")), s=roads.surface_of(F.lit("sett")), o=roads.surface_of(F.lit("moss")), n=roads.class_of_highway(F.lit("steps")),
    )
    assert tuple(r) == (3, False, True, "forward", 48, 50, 0, 4, 12, 0)


def test_names(spark):
    r = one(spark, a=text.normalized(F.lit("Étaples-sur-Mer")), b=text.normalized(F.lit("  --  ")), c=text.normalized(F.lit("Œuf")), p=text.population(F.lit("12 345,6 hab")), k=text.place_rank(F.lit(850), F.lit(12345)), t=text.turn_name(F.lit(-130.0)), d=text.distance_text(F.lit(1234.0)))
    assert tuple(r) == ("etaples sur mer", None, "oeuf", 123456, 930, "SHARP_LEFT", "1.2 km")


def test_search_order(spark):
    rows = [(1, "Bar Étaples", 3, 900, 0, 0), (2, "étaples", 3, 10, 0, 0), (3, "Etaples Test", 3, 700, 0, 0), (4, "Paris", 1, 1000, 0, 0)]
    places = spark.createDataFrame(rows, "place_id long, name string, kind int, rank int, lat_e7 long, lon_e7 long")
    assert [r.place_id for r in search.search(places, "Étaples").collect()] == [2, 3, 1]
    assert search.search(places, "e").count() == 0
    assert [r.place_id for r in search.merged([places, places], "etaples").orderBy("match").collect()] == [2, 3, 1]


def test_nearest_equals_linear(spark):
    lattice = nodes_of(spark, [(50.0 + 0.0031 * r, 2.5 + 0.0037 * c) for r in range(35) for c in range(45)])
    points = spark.createDataFrame([(0, 500500000, 25500000), (1, 501000001, 26000003), (2, 499000000, 24000000), (3, 530000000, 60000000), (4, 500310000, 25740000)], "point_id long, lat_e7 long, lon_e7 long")
    got = {r.point_id: r.node_id for r in spatial.nearest_node(points, lattice).collect()}
    far = geo.haversine_m(F.col("p.lat_e7") / 1e7, F.col("p.lon_e7") / 1e7, F.col("n.lat_e7") / 1e7, F.col("n.lon_e7") / 1e7)
    want = points.alias("p").crossJoin(lattice.alias("n")).groupBy("point_id").agg(F.min(F.struct(far.alias("d"), "node_id")).alias("b"))
    assert got == {r.point_id: r.b.node_id for r in want.collect()}


def test_snap(spark):
    located = spark.createDataFrame([(1, 2, 503710000, 30810000, 503720000, 30820000)], "a long, b long, a_lat long, a_lon long, b_lat long, b_lon long")
    points = spark.createDataFrame([(0, 503714800, 30815200), (1, 520000000, 30815200)], "point_id long, lat_e7 long, lon_e7 long")
    (r,) = spatial.snap(points, located, 100.0).collect()
    assert r.point_id == 0 and 0.45 < r.fraction < 0.55 and r.distance_m < 10


def test_gateways(spark):
    left = spark.createDataFrame([(0, 500000000, 29900000, 3), (1, 500000000, 30000000, 4)], "node_id long, lat_e7 long, lon_e7 long, best_class int")
    right = spark.createDataFrame([(0, 500000000, 30000000, 5), (9, 500000000, 30000000, 1)], left.schema)
    assert [tuple(r) for r in spatial.gateways(left, right).collect()] == [(1, 0, 500000000, 30000000, 1700)]


def test_off_route_between_bounds_keeps_its_state(spark):
    samples = spark.createDataFrame([(1, k, float(d)) for k, d in enumerate([0, 46, 33, 12, 40, 50])], "trip long, seq int, distance_m double")
    assert [r.off for r in tracks.off_route(samples).orderBy("seq").collect()] == [False, True, True, False, False, True]


def test_instructions_of_a_corner(spark):
    points = spark.createDataFrame([(1, 0, 500000000, 30000000), (1, 1, 500010000, 30000000), (1, 2, 500010000, 30010000)], "trip long, point int, lat_e7 long, lon_e7 long")
    rows = navigation.instructions(points).orderBy("point").collect()
    assert [r.kind for r in rows] == ["DEPART", "RIGHT", "ARRIVE"] and 80 < rows[1].turn < 100
    samples = spark.createDataFrame([(1, 0, 10.0), (1, 1, rows[1].at_m + 1), (1, 2, rows[1].at_m + 20)], "trip long, seq int, at_m double")
    assert [r.kind for r in navigation.next_instruction(samples, navigation.instructions(points)).orderBy("seq").collect()] == ["RIGHT", "RIGHT", "ARRIVE"]


def test_continues_merge_in_chains(spark):
    rows = spark.createDataFrame([(1, k, "CONTINUE" if k else "DEPART", float(d)) for k, d in enumerate([0, 100, 350, 600, 1000])], "trip long, point int, kind string, at_m double")
    assert [r.point for r in navigation.merged_continues(rows).orderBy("point").collect()] == [0, 3, 4]


def test_masks(spark):
    ring = spark.createDataFrame([(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)], "x int, y int")
    assert tiles.closed(ring).count() == 9
    assert tiles.boundary(ring).count() == 16
    assert sorted(map(tuple, tiles.runs(ring).collect())) == [(0, 0, 2), (1, 0, 0), (1, 2, 2), (2, 0, 2)]
    assert sorted(map(tuple, tiles.parents(ring).collect())) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    square = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2)])], "ring_id int, seq int, x long, y long")
    assert tiles.ring_areas(square).collect()[0].area2 == 8


def test_stores(spark):
    rows = spark.createDataFrame([("zoom", "1", 1), ("zoom", "3", 3), ("zoom", "2", 2)], "key string, value string, at int")
    assert store.upserted(rows, "key", "value", ["at"]).collect()[0].value == "3"
    assert [r.at for r in store.newest(rows, "at", "key", 2).collect()] == [3, 2]


def test_nearest_node_far_away(spark):
    """Points far from every node, and one whose own cells hold a farther node than the cells beyond."""
    points = spark.createDataFrame([(1, 800_000_000, 1_700_000_000), (2, -450_000_000, -1_600_000_000), (3, 0, 1)], "point_id long, lat_e7 long, lon_e7 long")
    nodes = spark.createDataFrame([(7, 430_000_000, 10_000_000), (8, 1, 5)], "node_id long, lat_e7 long, lon_e7 long")
    got = {r.point_id: r.node_id for r in spatial.nearest_node(points, nodes, 1000).collect()}
    assert set(got) == {1, 2, 3} and got[3] == 8 and got[1] == 7
    assert spatial.nearest_node(points, nodes.limit(0), 1000).count() == 0


def test_ways_in_a_circle_fail(spark):
    found = spark.createDataFrame([(0, 1, 0, 2), (0, 2, 0, 1)], "origin long, node long, cost long, via long")
    with pytest.raises(ValueError, match="circle"):
        graph.ways(found, found.select("origin", "node").limit(1))


def test_merged_search_drops_copies_before_the_cut(spark):
    """A place repeated often leaves room for the others, and signs don't push a short name out."""
    kind = "place_id long, name string, rank int, lat_e7 long, lon_e7 long"
    copies = [(k, "blue", 9, 1, 1) for k in range(60)]
    signed = [(100, "blue -- !! -- a", 5, 2, 2)] + [(200 + k, f"blue b{k:02d}", 5, 3 + k, 3) for k in range(30)]
    left, right = spark.createDataFrame(copies + signed, kind), spark.createDataFrame([(500, "Blue", 9, 1, 1)], kind)
    got = search.merged([left, right], "blue", 12).collect()
    want = sorted({(r[1]): r for r in signed}.values(), key=lambda r: (len(normal(spark, r[1])), r[1], r[0]))
    assert [r.place_id for r in got] == [0] + [r[0] for r in want[:11]]


def normal(spark, name):
    return one(spark, n=text.normalized(F.lit(name))).n


def test_nearest_across_180_degrees(spark):
    points = spark.createDataFrame([(1, 0, 1_799_000_000), (2, 0, -1_799_900_000), (3, 899_500_000, 0)], "point_id long, lat_e7 long, lon_e7 long")
    nodes = spark.createDataFrame([(1, 0, 1_790_000_000), (2, 0, -1_799_500_000), (3, 0, 1_799_950_000), (4, 899_900_000, 1_790_000_000), (5, 890_000_000, 0)], "node_id long, lat_e7 long, lon_e7 long")
    got = {r.point_id: (r.node_id, r.distance_m) for r in spatial.nearest_node(points, nodes).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 3, 2: 3, 3: 4} and got[2][1] < 1700
    located = spark.createDataFrame([(7, 8, -1_000_000, -1_799_990_000, 1_000_000, -1_799_990_000), (1, 2, -1_000_000, 1_790_000_000, 1_000_000, 1_790_000_000)], "a long, b long, a_lat long, a_lon long, b_lat long, b_lon long")
    near = spatial.snap(points.filter("point_id < 3"), located, 20_000.0).collect()
    assert {r.point_id: (r.a, round(r.fraction, 6)) for r in near} == {1: (7, 0.5), 2: (7, 0.5)} and min(r.distance_m for r in near) < 1100
