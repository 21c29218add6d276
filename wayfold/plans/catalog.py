"""The registry of the library's own queries and their DuckDB equivalents.

Every query runs over its whole tables. Doubles are rounded on both sides, so that the
last bits of trigonometric functions do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo, roads, text
from wayfold.operators import graph, navigation, search, spatial, store, tiles, tracks
from wayfold.plans import ground, journeys, more, oracles, world  # noqa: F401  ground and journeys add to more's queries
from wayfold.session import table
from wayfold.sources import geo_tables as g

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = more.QUERIES | world.QUERIES
ORACLES: dict[str, str] = oracles.SQL | more.ORACLES | world.ORACLES


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _deg(name: str):
    return F.col(name) / 1e7


def _located_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Short segments between consecutive points of the routes, with both ends."""
    order = Window.partitionBy("trip").orderBy("point")
    r = g.routes(spark, sf)
    ends = r.select(
        (F.col("trip") * 1_000_000 + F.col("point")).alias("a"),
        F.lead(F.col("trip") * 1_000_000 + F.col("point")).over(order).alias("b"),
        F.col("lat_e7").alias("a_lat"), F.col("lon_e7").alias("a_lon"), F.lead("lat_e7").over(order).alias("b_lat"), F.lead("lon_e7").over(order).alias("b_lon"),
    )
    return ends.filter("b IS NOT NULL")


def _query_points(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as points between the nodes."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("point_id"), (F.lit(420000000) + (k * 6151 % 90000) * 1000 + 137).cast("long").alias("lat_e7"), (F.lit(-45000000) + (k * 98953 % 120000) * 1000 + 411).cast("long").alias("lon_e7"))


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """A mask from the order table: cells of a 600 x 600 square."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(((k * 7919 + k % 13) % 600).cast("int").alias("x"), ((k * 31 + k % 7) % 600).cast("int").alias("y")).distinct()


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the unit square from line items."""
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    x, y = (k * 7919 % 100000) / 100000.0, (k * 104729 % 100000) / 100000.0
    return table(spark, sf, "lineitem").select((k * 10 + F.col("l_linenumber")).alias("line_id"), (k % 3).cast("int").alias("kind"), x.alias("x1"), y.alias("y1"), (x + (p % 97 - 48) / 50000.0).alias("x2"), (y + (p % 89 - 44) / 50000.0).alias("y2"))


@query
def geo_haversine_edges(spark: SparkSession, sf: str) -> DataFrame:
    return g.edges(spark, sf).groupBy("road_class").agg(F.count("*").alias("n"), F.sum("length_cm").alias("length_cm"), F.max("length_cm").alias("longest_cm"))


@query
def mercator_tiles(spark: SparkSession, sf: str) -> DataFrame:
    n = g.nodes(spark, sf)
    x, y = geo.mercator_x(_deg("lon_e7")), geo.mercator_y(_deg("lat_e7"))
    return n.select("node_id", geo.tile(x, F.lit(12)).alias("tile_x"), geo.tile(y, F.lit(12)).alias("tile_y"), F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))


@query
def tile_counts_by_zoom(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.tile_counts(g.nodes(spark, sf), [6, 8, 10, 12, 14])


@query
def grid_cells_csr(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.cell_counts(g.nodes(spark, sf), 2_500_000)


@query
def segments_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.segments(g.edges(spark, sf))


@query
def nearest_node(spark: SparkSession, sf: str) -> DataFrame:
    found = spatial.nearest_node(_query_points(spark, sf), g.nodes(spark, sf), 500_000)
    return found.select("point_id", "node_id", F.round("distance_m", 3).alias("distance_m"))


@query
def snap_segment(spark: SparkSession, sf: str) -> DataFrame:
    """Every sample, set off its own way by some metres, to the nearest segment of any way."""
    points = g.track(spark, sf).select((F.col("trip") * 1_000_000 + F.col("seq")).alias("point_id"), (F.col("lat_e7") + 1370).alias("lat_e7"), (F.col("lon_e7") - 2110).alias("lon_e7"))
    found = spatial.snap(points, _located_segments(spark, sf), 60.0)
    return found.select("point_id", "a", "b", F.round("distance_m", 3).alias("distance_m"))


def _regions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n = g.nodes(spark, sf).join(spatial.best_classes(g.edges(spark, sf)), "node_id")
    return n.filter("node_id % 3 IN (0, 1)"), n.filter("node_id % 3 IN (1, 2)")


@query
def gateways_exact_join(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.gateways(*_regions(spark, sf))


@query
def gateways_topk(spark: SparkSession, sf: str) -> DataFrame:
    top = spatial.top_gateways(spatial.gateways(*_regions(spark, sf)), (43.5, -1.25), (48.25, 5.5))
    return top.select("left_node", "right_node", "penalty_m", F.round("score", 3).alias("score"))


@query
def edge_costs_by_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = roads.edge_costs(g.edges(spark, sf), avoid_tolls=True)
    return rows.groupBy("profile", "road_class").agg(F.count("*").alias("n"), F.sum(F.round(F.col("seconds") * 1000).cast("long")).alias("ms"), F.sum(F.round(F.col("cost") * 1000).cast("long")).alias("cost_ms"))


def _arcs(spark: SparkSession, sf: str) -> DataFrame:
    rows = roads.edge_costs(g.edges(spark, sf)).filter("profile = 'TOURING'").withColumn("ms", F.round(F.col("cost") * 1000).cast("long"))
    return graph.cheapest_arcs(rows, "ms")


def _costs(spark: SparkSession, sf: str) -> DataFrame:
    start = spark.createDataFrame([(0, 1, 0), (1, 7, 0), (1, 11, 60_000)], "origin int, node long, cost long")
    return graph.shortest(_arcs(spark, sf), start)


@query
def sssp_costs(spark: SparkSession, sf: str) -> DataFrame:
    return _costs(spark, sf).select("origin", "node", "cost")


@query
def route_points(spark: SparkSession, sf: str) -> DataFrame:
    """Node sequences of the ways to every node reached."""
    found = _costs(spark, sf)
    return graph.ways(found, found.select("origin", "node"))


@query
def region_corridor(spark: SparkSession, sf: str) -> DataFrame:
    """Hops between regions over the derived adjacency, from region 0."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n"))
    near = graph.adjacent(n.select(F.col("n").alias("a"), ((F.col("n") + 1) % 25).alias("b")).union(n.select("n", ((F.col("n") * 7 + 3) % 25).alias("b"))))
    arcs = near.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).cast("long").alias("cost"))
    return graph.shortest(arcs, spark.createDataFrame([(0, 0, 0)], "origin int, node long, cost long")).select("node", "cost")


@query
def missing_regions(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "nation").select(F.col("n_nationkey").alias("region_id"))
    present = table(spark, sf, "supplier").filter("s_nationkey % 3 <> 0").select(F.col("s_nationkey").alias("region_id")).distinct()
    return graph.missing(wanted, present, "region_id")


@query
def graph_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of edges that only the regional half of the nodes lacks."""
    return graph.invalid_nodes(g.nodes(spark, sf).filter("node_id % 3 <> 2"), g.edges(spark, sf)).groupBy("side").agg(F.count("*").alias("n"))


@query
def place_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(g.places(spark, sf), " Réd ", 20).select("place_id", "name", "match", "rank")


@query
def place_search_multi(spark: SparkSession, sf: str) -> DataFrame:
    p = g.places(spark, sf)
    found = search.merged([p.filter("place_id % 2 = 0"), p.filter("place_id % 2 = 1 OR place_id % 3 = 0")], "blue", 12)
    return found.select("place_id", "name", "match", "rank", "source_no")


@query
def trip_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.cumulative(g.track(spark, sf)).select("trip", "seq", F.round("step_m", 3).alias("step_m"), F.round("total_m", 2).alias("total_m"))


@query
def turn_instructions(spark: SparkSession, sf: str) -> DataFrame:
    return navigation.instructions(g.routes(spark, sf)).select("trip", "point", "kind", F.round("at_m", 2).alias("at_m"), F.round("turn", 4).alias("turn"))


def _ahead(spark: SparkSession, sf: str) -> DataFrame:
    way = tracks.cumulative(g.routes(spark, sf), "point").select("trip", F.col("point").alias("seq"), F.col("total_m").alias("at_m"))
    return navigation.next_instruction(way, navigation.instructions(g.routes(spark, sf)))


@query
def instruction_asof(spark: SparkSession, sf: str) -> DataFrame:
    return _ahead(spark, sf).select("trip", "seq", "point", "kind", F.round("ahead_m", 2).alias("ahead_m"))


@query
def announcements(spark: SparkSession, sf: str) -> DataFrame:
    speeds = g.track(spark, sf).select("trip", (F.col("seq") - 1).alias("seq"), (F.col("speed_cms") / 100).alias("speed_mps"))
    return navigation.announcements(_ahead(spark, sf).join(speeds, ["trip", "seq"]))


@query
def track_islands_longest(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.longest_island(g.track(spark, sf), (F.col("seq") == 1) | (F.col("event_id") % 7 == 0))


@query
def trip_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.trip_stats(g.track(spark, sf)).withColumn("distance_m", F.round("distance_m", 2))


@query
def off_route_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    samples = g.track(spark, sf).select("trip", "seq", (F.col("event_id") * 7919 % 90).cast("double").alias("distance_m"))
    return tracks.off_route(samples).groupBy("trip").agg(F.count_if("off").alias("off"), F.count("*").alias("samples"))


@query
def location_filter(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.filtered(g.track(spark, sf)).select("trip", "seq", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query
def gps_quality_counts(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("trip").orderBy("seq")
    age = F.col("dt_s") * (1 + F.col("event_id") % 2)
    rows = g.track(spark, sf).withColumn("state", tracks.quality((F.col("event_id") * 31 % 80).cast("double"), age.cast("double"), F.col("heading_deg") < 350)).withColumn("changed", F.coalesce(F.lag("state").over(order) != F.col("state"), F.lit(True)))
    return rows.groupBy("state").agg(F.count("*").alias("n"), F.count_if("changed").alias("changes"))


@query
def mask_closing(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.closed(_cells(spark, sf))


@query
def mask_pyramid_or(spark: SparkSession, sf: str) -> DataFrame:
    cells = _cells(spark, sf)
    out = [tiles.parents(cells, k).withColumn("level", F.lit(k)) for k in (1, 2, 3)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def sparse_filter(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.dense(_cells(spark, sf)).select("x", "y", "n")


@query
def mask_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.boundary(_cells(spark, sf))


@query
def mask_runs(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.runs(_cells(spark, sf))


@query
def line_clip_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.clipped_lines(_lines(spark, sf), 10).select("line_id", "tile_x", "tile_y", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


@query
def overview_generalize(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.generalized(_lines(spark, sf), 4096)


@query
def robust_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.robust_bounds(g.nodes(spark, sf), trim=0.01)


@query
def polygon_area(spark: SparkSession, sf: str) -> DataFrame:
    rings = g.routes(spark, sf).select(F.col("trip").alias("ring_id"), F.col("point").alias("seq"), ((F.col("lon_e7") - 10_000_000) / 10).cast("long").alias("x"), ((F.col("lat_e7") - 430_000_000) / 10).cast("long").alias("y"))
    return tiles.ring_areas(rings)


@query
def topk_history(spark: SparkSession, sf: str) -> DataFrame:
    return store.newest(table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderdate", "o_orderkey")


@query
def settings_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return store.upserted(table(spark, sf, "events"), "event_type", "props", ["ts", "event_id"])


@query
def labels_lod(spark: SparkSession, sf: str) -> DataFrame:
    places = g.places(spark, sf).withColumn("region", F.col("place_id") % 25)
    return store.reference_labels(places, "region").select("region", "place_id", "kind", "nth")


@query
def place_normalize(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit(" Étang-du "), "s_name", F.lit(" Œuvre ")).alias("name"))
    return names.select("s_suppkey", text.normalized(F.col("name")).alias("normalized"), text.distance_text((F.col("s_suppkey") * 37 % 20000).cast("double")).alias("spoken"))


@query
def route_overlap(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("route"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_partkey") % 40).alias("a"), (F.col("l_orderkey") % 40).alias("b"), (F.col("l_quantity") * 100).cast("long").alias("length_cm"))
    return graph.repeated_cm(steps)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trip's samples with the way so far and the nearest node of its first sample."""
    way = tracks.cumulative(g.track(spark, sf_dir))
    starts = way.filter("seq = 1").select(F.col("trip").alias("point_id"), "lat_e7", "lon_e7")
    node = spatial.nearest_node(starts, g.nodes(spark, sf_dir), 2_000_000).select(F.col("point_id").alias("trip"), "node_id", F.round("distance_m", 3).alias("start_m"))
    return way.join(node, "trip").groupBy("trip", "node_id", "start_m").agg(F.count("*").alias("samples"), F.round(F.max("total_m"), 2).alias("total_m"))


QUERIES["flagship"] = flagship
