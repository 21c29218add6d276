"""Registered queries over several regions, levels of the map, and events along tracks; each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import formats, roads, text
from wayfold.operators import navigation, routing, search, spatial, store, tiles, tracks
from wayfold.plans import more
from wayfold.plans import oracles as o
from wayfold.session import table
from wayfold.sources import geo_tables as g
from wayfold.sources import regions as r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


# Several regions ----------------------------------------------------------------------------------

_GATE = "CASE WHEN best_class <= 3 THEN 0 WHEN best_class = 4 THEN 500 WHEN best_class = 5 THEN 1200 ELSE 3000 END"
_HOPS = "\n".join(
    f"""walk{k}(request, node, cost) USING KEY (request, node) AS (SELECT request, node, cost FROM open{k}
  UNION (SELECT w.request, a.dst, min(w.cost + a.c) FROM walk{k} w JOIN arcs{k} a ON a.src = w.node LEFT JOIN recurring.walk{k} x ON x.request = w.request AND x.node = a.dst WHERE x.cost IS NULL OR w.cost + a.c < x.cost GROUP BY ALL)),
reached{k} AS (SELECT n.request, n.node, n.score, w.cost FROM near{k} n JOIN walk{k} w USING (request, node)),
open{k + 1} AS (SELECT request, node, cost FROM reached{k}),"""
    for k in (0, 1)
)
_NEAR = ",\n".join(
    f"""gates{k} AS (SELECT node_id AS node, lat_e7 / 1e7 AS la, lon_e7 / 1e7 AS lo, least(65535, 2 * {_GATE}) AS penalty FROM withclass WHERE node_id % 4 = {k + 1}),
near{k} AS (SELECT request, g.node, round({o.hav("slat", "slon", "la", "lo")} + {o.hav("la", "lo", "glat", "glon")} + penalty, 3) AS score FROM asked, gates{k} g QUALIFY row_number() OVER (PARTITION BY request ORDER BY score, g.node) <= 8)"""
    for k in (0, 1)
)


@query(
    f"""WITH RECURSIVE {o.COSTS}, best_ AS (SELECT src AS node_id, coalesce(min(CASE WHEN road_class > 0 THEN road_class END), 12) AS best_class FROM edges GROUP BY src), withclass AS (SELECT * FROM nodes JOIN best_ USING (node_id)),
all_arcs AS (SELECT src, dst, min(round(cost * 1000)::BIGINT) AS c FROM costs WHERE profile = 'TOURING' GROUP BY ALL),
arcs0 AS (SELECT * FROM all_arcs WHERE src % 4 IN (0, 1) AND dst % 4 IN (0, 1)), arcs1 AS (SELECT * FROM all_arcs WHERE src % 4 IN (1, 2) AND dst % 4 IN (1, 2)), arcs2 AS (SELECT * FROM all_arcs WHERE src % 4 IN (2, 3) AND dst % 4 IN (2, 3)),
asked AS (SELECT r_regionkey::BIGINT AS request, a.node_id AS start, a.lat_e7 / 1e7 AS slat, a.lon_e7 / 1e7 AS slon, b.node_id AS goal, b.lat_e7 / 1e7 AS glat, b.lon_e7 / 1e7 AS glon FROM region JOIN nodes a ON a.node_id = r_regionkey * 8 + 4 JOIN nodes b ON b.node_id = r_regionkey * 12 + 3),
{_NEAR},
open0 AS (SELECT request, start AS node, 0::BIGINT AS cost FROM asked),
{_HOPS}
walk2(request, node, cost) USING KEY (request, node) AS (SELECT request, node, cost FROM open2
  UNION (SELECT w.request, a.dst, min(w.cost + a.c) FROM walk2 w JOIN arcs2 a ON a.src = w.node LEFT JOIN recurring.walk2 x ON x.request = w.request AND x.node = a.dst WHERE x.cost IS NULL OR w.cost + a.c < x.cost GROUP BY ALL))
SELECT request, cost, 2 AS n_gates FROM walk2 JOIN asked USING (request) WHERE node = goal"""
)
def route_across_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The cheapest ways from one region over a second into a third, by at most eight gateways a boundary."""
    n = g.nodes(spark, sf)
    rows = roads.edge_costs(g.edges(spark, sf)).filter("profile = 'TOURING'").withColumn("ms", F.round(F.col("cost") * 1000).cast("long"))
    arcs = rows.groupBy("src", "dst").agg(F.min("ms").alias("cost"))
    part = lambda a, b: arcs.filter(f"src % 4 IN ({a}, {b}) AND dst % 4 IN ({a}, {b})")
    shared = n.join(spatial.best_classes(g.edges(spark, sf)), "node_id")
    gates = []
    for k in (1, 2):
        own = shared.filter(f"node_id % 4 = {k}")
        penalty = F.least(F.lit(65535), 2 * roads.gateway_penalty_m(F.col("best_class")))
        gates.append(own.select(F.col("node_id").alias("left_node"), F.col("node_id").alias("right_node"), "lat_e7", "lon_e7", penalty.alias("penalty")))
    k = F.col("r_regionkey")
    asked = table(spark, sf, "region").select(k.cast("long").alias("request"), (k * 8 + 4).cast("long").alias("start"), (k * 12 + 3).cast("long").alias("goal"))
    found = routing.across(asked, [part(0, 1), part(1, 2), part(2, 3)], gates, n.withColumnRenamed("node_id", "node"))
    return found.select("request", "cost", F.size("gates").alias("n_gates"))


_CITIES = ", ".join(f"({-1 - k}, '{name}', {kind}, {rank}, {round(lat * 1e7)}, {round(lon * 1e7)})" for k, (name, lat, lon, kind, rank, _) in enumerate(r.CITIES))


@query(
    f"""WITH c AS (SELECT *, {o.normalized("name")} AS normalized FROM (VALUES {_CITIES}) t(place_id, name, kind, rank, lat_e7, lon_e7)), a AS (SELECT DISTINCT substr({o.normalized("p_name")}, 1, 2) AS asked FROM part),
    m AS (SELECT *, CASE WHEN normalized = asked THEN 0 WHEN starts_with(normalized, asked) THEN 1 WHEN contains(normalized, asked) THEN 2 END AS match FROM c, a WHERE length(asked) = 2)
    SELECT asked, place_id::BIGINT AS place_id, name, match, rank FROM m WHERE match IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asked ORDER BY match, rank DESC, length(name), lower(name), place_id) <= 8"""
)
def city_search(spark: SparkSession, sf: str) -> DataFrame:
    """The well-known cities found by the first two letters of each part's name, the eight best for each."""
    asked = table(spark, sf, "part").select(F.substring(text.normalized(F.col("p_name")), 1, 2).alias("asked")).distinct().filter(F.length("asked") == 2)
    return search.by_pairs(r.cities(spark), asked, 8).select("asked", "place_id", "name", "match", "rank")


# Levels and tiles ---------------------------------------------------------------------------------


def _closing(name: str, source: str) -> str:
    return f"w_{name} AS (SELECT DISTINCT x + dx AS x, y + dy AS y FROM {source}, nine), {name} AS (SELECT x + dx AS x, y + dy AS y FROM w_{name}, nine GROUP BY 1, 2 HAVING count(*) = 9)"


@query(
    f"""WITH {o.CELLS}, fine AS (SELECT DISTINCT x * 37 AS x, y * 41 AS y FROM cells), p11 AS (SELECT DISTINCT x >> 5 AS x, y >> 5 AS y FROM fine), {_closing("l11", "p11")}, p10 AS (SELECT DISTINCT x >> 1 AS x, y >> 1 AS y FROM l11), {_closing("l10", "p10")},
    p9 AS (SELECT DISTINCT x >> 1 AS x, y >> 1 AS y FROM l10), {_closing("m9", "p9")}, {_closing("l9", "m9")} SELECT 11 AS level, x, y FROM l11 UNION ALL SELECT 10, x, y FROM l10 UNION ALL SELECT 9, x, y FROM l9"""
)
def landcover_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Coarser levels of a mask with closing passes between them."""
    k = F.col("o_orderkey")
    cells = table(spark, sf, "orders").select((((k * 7919 + k % 13) % 600) * 37).cast("int").alias("x"), (((k * 31 + k % 7) % 600) * 41).cast("int").alias("y")).distinct()
    return tiles.levels(cells)


_ZOOMS = (8, 9, 10, 11, 12)
_CLIP = " UNION ALL ".join(
    f"""SELECT {z} AS zoom, * FROM (WITH s AS (SELECT line_id, x1 * {1 << z} AS x1, y1 * {1 << z} AS y1, x2 * {1 << z} - x1 * {1 << z} AS dx, y2 * {1 << z} - y1 * {1 << z} AS dy, floor(least(x1, x2) * {1 << z})::INT AS lx, floor(greatest(x1, x2) * {1 << z})::INT AS hx, floor(least(y1, y2) * {1 << z})::INT AS ly, floor(greatest(y1, y2) * {1 << z})::INT AS hy FROM lines),
    c AS (SELECT * FROM s, LATERAL (SELECT unnest(range(lx, hx + 1))::INT AS tile_x), LATERAL (SELECT unnest(range(ly, hy + 1))::INT AS tile_y) WHERE hx - lx <= 64 AND hy - ly <= 64)
    SELECT line_id, tile_x, tile_y, greatest(0.0, CASE WHEN dx = 0 THEN 0.0 ELSE least((tile_x - x1) / dx, (tile_x + 1 - x1) / dx) END, CASE WHEN dy = 0 THEN 0.0 ELSE least((tile_y - y1) / dy, (tile_y + 1 - y1) / dy) END) AS t0,
    least(1.0, CASE WHEN dx = 0 THEN 1.0 ELSE greatest((tile_x - x1) / dx, (tile_x + 1 - x1) / dx) END, CASE WHEN dy = 0 THEN 1.0 ELSE greatest((tile_y - y1) / dy, (tile_y + 1 - y1) / dy) END) AS t1 FROM c WHERE (dx <> 0 OR x1 BETWEEN tile_x AND tile_x + 1) AND (dy <> 0 OR y1 BETWEEN tile_y AND tile_y + 1)) WHERE t0 < t1"""
    for z in _ZOOMS
)


@query(f"WITH {o.LINES}, parts AS ({_CLIP}) SELECT zoom, count(*) AS records, count(DISTINCT (tile_x, tile_y)) AS tiles, round(sum(t1 - t0), 4) AS lines FROM parts GROUP BY 1")
def overlay_retiled(spark: SparkSession, sf: str) -> DataFrame:
    """Lines cut anew for several zooms: records, tiles, and the parts' sum, which is the number of lines."""
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    x, y = (k * 7919 % 100000) / 100000.0, (k * 104729 % 100000) / 100000.0
    lines = table(spark, sf, "lineitem").select((k * 10 + F.col("l_linenumber")).alias("line_id"), x.alias("x1"), y.alias("y1"), (x + (p % 97 - 48) / 50000.0).alias("x2"), (y + (p % 89 - 44) / 50000.0).alias("y2"))
    parts = tiles.retiled(lines, _ZOOMS, 64)
    per_tile = parts.groupBy("zoom", "tile_x", "tile_y").agg(F.count("*").alias("n"), F.sum(F.col("t1") - F.col("t0")).alias("s"))
    return per_tile.groupBy("zoom").agg(F.sum("n").alias("records"), F.count("*").alias("tiles"), F.round(F.sum("s"), 4).alias("lines"))


_LEAST = ", ".join(f"({z}, {a}::DOUBLE)" for z, a in tiles.LEAST_PIXELS.items())


@query(
    f"""WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS ring_id, l_extendedprice::DOUBLE / 1e13 AS world_area, l_linenumber % 2 = 0 AS water FROM lineitem), z AS (SELECT * FROM (VALUES {_LEAST}) t(zoom, least_)),
    k AS (SELECT zoom, world_area * power(4.0::DOUBLE, zoom) * 65536 AS pixels, least_ * CASE WHEN water THEN 0.5 ELSE 1.0 END AS least_ FROM a, z) SELECT zoom, count(*) AS n, round(sum(pixels), 2) AS pixels FROM k WHERE pixels >= least_ GROUP BY 1"""
)
def areas_by_zoom(spark: SparkSession, sf: str) -> DataFrame:
    """How many areas are large enough to be kept at each zoom."""
    areas = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ring_id"), (F.col("l_extendedprice").cast("double") / 1e13).alias("world_area"), (F.col("l_linenumber") % 2 == 0).alias("water"))
    return tiles.large_enough(areas).groupBy("zoom").agg(F.count("*").alias("n"), F.round(F.sum("pixels"), 2).alias("pixels"))


# Events along tracks ------------------------------------------------------------------------------


@query(
    f"""WITH {o.TRACK}, s AS (SELECT trip, seq, (event_id * 7919 % 90)::DOUBLE AS d FROM track), f AS (SELECT *, coalesce(last_value(CASE WHEN d > 45 THEN true WHEN d <= 25 THEN false END IGNORE NULLS) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING), false) AS off FROM s),
    n AS (SELECT *, CASE WHEN off THEN 'OFF_ROUTE' ELSE 'ON_ROUTE' END AS state FROM f) SELECT trip, seq::INT AS seq, state FROM n QUALIFY lag(state) OVER (PARTITION BY trip ORDER BY seq) IS DISTINCT FROM state"""
)
def route_state_events(spark: SparkSession, sf: str) -> DataFrame:
    """When a trip leaves its route and when it is back: what guidance announces once."""
    samples = g.track(spark, sf).select("trip", "seq", (F.col("event_id") * 7919 % 90).cast("double").alias("distance_m"))
    return tracks.state_events(tracks.off_route(samples), F.when(F.col("off"), "OFF_ROUTE").otherwise("ON_ROUTE"))


@query(
    f"""WITH {o.TRACK}, t AS (SELECT trip, seq, sum(dt_s * (1 + event_id % 3)) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING)::DOUBLE AS at_s FROM track), s AS (SELECT *, lead(at_s) OVER (PARTITION BY trip ORDER BY seq) - at_s AS silent_s FROM t)
    SELECT trip, seq::INT AS seq, at_s + 5 AS lost_at_s, silent_s FROM s WHERE silent_s > 5"""
)
def gps_lost_events(spark: SparkSession, sf: str) -> DataFrame:
    """When a signal counts as lost."""
    so_far = Window.partitionBy("trip").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return tracks.lost_signals(g.track(spark, sf).select("trip", "seq", F.sum(F.col("dt_s") * (1 + F.col("event_id") % 3)).over(so_far).cast("double").alias("at_s")))


@query(
    f"""WITH {o.TRACK}, {o.STEPS}, w AS (SELECT trip, (seq - 1)::INT AS point, sum(step_m) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING) AS m FROM stepped), ends AS (SELECT trip, max(m) AS total FROM w GROUP BY 1),
    p AS (SELECT trip, unnest(range((total / 250)::BIGINT)) * 250.0::DOUBLE + 0.5 AS place_m FROM ends) SELECT p.trip, place_m, w.point, round(place_m - w.m, 2) AS rest_m FROM p ASOF JOIN w ON w.trip = p.trip AND w.m <= p.place_m"""
)
def segment_asof(spark: SparkSession, sf: str) -> DataFrame:
    """The segment that holds each place, one every 250 metres."""
    way = tracks.cumulative(g.routes(spark, sf), "point").select("trip", "point", "total_m")
    ends = way.groupBy("trip").agg(F.max("total_m").alias("total")).withColumn("n", F.round(F.col("total") / 250).cast("long")).filter("n > 0")
    places = ends.select("trip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).select("trip", (F.col("k") * 250.0 + 0.5).alias("place_m"))
    return tracks.segments_at(places, way).withColumn("rest_m", F.round("rest_m", 2))


@query(
    f"""WITH {o.TRACK}, {o.STEPS}, i AS (SELECT *, sum((seq = 1 OR event_id % 7 = 0)::INT) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM stepped), c AS (SELECT trip, island, count(*) AS n FROM i GROUP BY ALL HAVING count(*) >= 2),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY trip ORDER BY n DESC, island) = 1), p AS (SELECT i.*, row_number() OVER (PARTITION BY i.trip ORDER BY seq) AS nth FROM i JOIN b USING (trip, island)),
    t AS (SELECT trip, CASE WHEN nth = 1 THEN 0.0 ELSE step_m END AS m, CASE WHEN speed_cms * 0.036 < 5 THEN 50.0 ELSE least(160.0, speed_cms * 0.036::DOUBLE) END AS kph FROM p) SELECT trip, count(*) AS points, round(sum(m), 2) AS length_m, round(sum(m / (kph / 3.6)), 2) AS time_s FROM t GROUP BY 1"""
)
def recorded_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Each trip's longest recorded stretch as a route: points, length and time."""
    starts = (F.col("seq") == 1) | (F.col("event_id") % 7 == 0)
    rows = tracks.islands(tracks.cumulative(g.track(spark, sf)), starts)
    own = rows.join(tracks.longest_island(g.track(spark, sf), starts).select("trip", "island"), ["trip", "island"])
    first = F.lag("seq").over(Window.partitionBy("trip").orderBy("seq")).isNull()
    points = own.withColumns({"step_m": F.when(first, 0.0).otherwise(F.col("step_m")), "speed_kph": F.col("speed_cms") * 0.036})
    timed = tracks.ridden_times(points)
    return timed.groupBy("trip").agg(F.count("*").alias("points"), F.round(F.sum("step_m"), 2).alias("length_m"), F.round(F.max("time_s"), 2).alias("time_s"))


@query(
    """WITH t AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey || ', ' || s_acctbal WHEN 1 THEN s_suppkey || ',x' WHEN 2 THEN s_suppkey::VARCHAR ELSE ' -1e1,' || s_suppkey || '.5 ' END AS pair, s_name || ' & <' || s_suppkey || '>' AS name FROM supplier)
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey::DOUBLE WHEN 3 THEN -10.0 END AS first, CASE WHEN s_suppkey % 4 = 2 THEN s_suppkey::INT ELSE -1 END AS whole, replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS encoded, name AS decoded FROM t"""
)
def formats_read(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of numbers, whole numbers, and entities there and back."""
    k = F.col("s_suppkey")
    pair = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(", "), F.col("s_acctbal").cast("string"))).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(",x"))).when(k % 4 == 2, k.cast("string")).otherwise(F.concat(F.lit(" -1e1,"), k.cast("string"), F.lit(".5 ")))
    rows = table(spark, sf, "supplier").select("s_suppkey", pair.alias("pair"), F.concat("s_name", F.lit(" & <"), k.cast("string"), F.lit(">")).alias("name"))
    encoded = formats.encoded(F.col("name"))
    return rows.select("s_suppkey", formats.numbers(F.col("pair"), 2)[0].alias("first"), F.coalesce(formats.whole_number(F.col("pair")), F.lit(-1)).alias("whole"), encoded.alias("encoded"), formats.decoded(encoded).alias("decoded"))


@query(
    f"""WITH {o.INSTRUCTIONS}, marks AS (SELECT *, at_m + 5.0 AS until FROM instructions) SELECT s.trip, s.point AS seq, m.point, m.kind, round(m.at_m - s.at_m, 2) AS ahead_m FROM turned s JOIN marks m ON m.trip = s.trip AND m.until >= s.at_m
    QUALIFY row_number() OVER (PARTITION BY s.trip, s.point ORDER BY m.until, m.point) = 1"""
)
def instruction_asof_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """The next instruction with a fixed margin of five metres."""
    way = tracks.cumulative(g.routes(spark, sf), "point").select("trip", F.col("point").alias("seq"), F.col("total_m").alias("at_m"))
    found = navigation.next_instruction(way, navigation.instructions(g.routes(spark, sf)), 5.0)
    return found.select("trip", "seq", "point", "kind", F.round("ahead_m", 2).alias("ahead_m"))


# Inside tiles, and packages -----------------------------------------------------------------------


@query(
    f"""WITH {o.EDGES}, t AS (SELECT (lon_e7 // 5000000)::INT AS tile_x, (lat_e7 // 5000000)::INT AS tile_y, road_class FROM edges JOIN nodes ON node_id = src), c AS (SELECT tile_x, tile_y, road_class, count(*) AS n FROM t GROUP BY ALL)
    SELECT *, coalesce(sum(n) OVER (PARTITION BY tile_x, tile_y ORDER BY road_class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM c"""
)
def tile_class_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where each class of road begins among a tile's records."""
    rows = g.edges(spark, sf).join(g.nodes(spark, sf).withColumnRenamed("node_id", "src"), "src")
    return tiles.class_offsets(rows.select(F.expr("CAST(lon_e7 DIV 5000000 AS INT)").alias("tile_x"), F.expr("CAST(lat_e7 DIV 5000000 AS INT)").alias("tile_y"), "road_class"))


@query(
    f"""WITH {o.LINES}, n AS (SELECT *, (row_number() OVER (PARTITION BY kind ORDER BY line_id, x2, y2) - 1) // 256 AS chunk FROM (SELECT DISTINCT * FROM lines))
    SELECT kind, chunk, count(*) AS n, round(min(least(x1, x2)), 9) AS low_x, round(min(least(y1, y2)), 9) AS low_y, round(max(greatest(x1, x2)), 9) AS high_x, round(max(greatest(y1, y2)), 9) AS high_y FROM n GROUP BY 1, 2"""
)
def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines in runs of 256 with the box around each run."""
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    x, y = (k * 7919 % 100000) / 100000.0, (k * 104729 % 100000) / 100000.0
    lines = table(spark, sf, "lineitem").select((k * 10 + F.col("l_linenumber")).alias("line_id"), (k % 3).cast("int").alias("kind"), x.alias("x1"), y.alias("y1"), (x + (p % 97 - 48) / 50000.0).alias("x2"), (y + (p % 89 - 44) / 50000.0).alias("y2")).distinct()
    runs = tiles.chunked(lines, "kind", F.struct("line_id", "x2", "y2"), F.floor(F.col("line_id") / 4096))
    return runs.select("kind", "chunk", "n", *[F.round(c, 9).alias(c) for c in ("low_x", "low_y", "high_x", "high_y")])


@query(
    f"""WITH {more._FEATURES}, d AS (SELECT * FROM (VALUES ('water', 'area', 1.25::DOUBLE), ('water', 'area', 0.35), ('built_up', 'mask', NULL), ('building', 'mask', NULL), ('green', 'mask', NULL), ('river', 'line', NULL), ('drain', 'line', NULL)) t(kind, layer, tolerance_px))
    SELECT layer, kind, coalesce(tolerance_px, 0) AS tolerance_px, count(*) AS n FROM kept JOIN d USING (kind) GROUP BY ALL"""
)
def feature_layers(spark: SparkSession, sf: str) -> DataFrame:
    """How many features go to each layer of the map."""
    rows, t = more._features(spark, sf), F.col("tags")
    kinds = rows.select(F.coalesce(more.ways.area_kind(t), more.ways.waterway_kind(t), more.ways.overview_kind(t)).alias("kind")).filter("kind IS NOT NULL")
    return tiles.dispatched(kinds).groupBy("layer", "kind", F.coalesce("tolerance_px", F.lit(0.0)).alias("tolerance_px")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {o.NODES}, {o.POINTS}, h AS (SELECT min(lat_e7) AS s, max(lat_e7) AS n, min(lon_e7) AS w, max(lon_e7) AS e FROM nodes WHERE node_id % 10 = 3) SELECT point_id FROM points, h WHERE lat_e7 BETWEEN s AND n AND lon_e7 BETWEEN w AND e"""
)
def points_in_extent(spark: SparkSession, sf: str) -> DataFrame:
    """The points inside the extent of a graph."""
    k = F.col("s_suppkey")
    points = table(spark, sf, "supplier").select(k.alias("point_id"), (F.lit(420000000) + (k * 6151 % 90000) * 1000 + 137).cast("long").alias("lat_e7"), (F.lit(-45000000) + (k * 98953 % 120000) * 1000 + 411).cast("long").alias("lon_e7"))
    return spatial.within(points, g.nodes(spark, sf).filter("node_id % 10 = 3")).select("point_id")


_ARTEFACTS = ("map", "routing", "search", "source", "map")


@query(
    f"""WITH f AS (SELECT (s_suppkey * 5 % 27)::INT AS region_no, ['map', 'routing', 'search', 'source', 'map'][1 + s_suppkey % 5] AS artefact, (s_suppkey * 1000)::BIGINT AS bytes FROM supplier), regions AS (SELECT * FROM (VALUES {more._REGIONS}) t(region_no, region, lat, lon)),
    g AS (SELECT region_no, bool_or(artefact = 'map') AS m, bool_or(artefact = 'routing') AS r, bool_or(artefact = 'search') AS s, bool_or(artefact = 'source') AS p, sum(bytes)::BIGINT AS bytes FROM f GROUP BY 1)
    SELECT region_no, region, coalesce(m, false) AS has_map, coalesce(r, false) AS has_routing, coalesce(s, false) AS has_search, coalesce(bytes, 0) AS bytes, coalesce(m AND r AND s, false) AS installed, coalesce((m AND r AND s) OR p, false) AS ready FROM regions LEFT JOIN g USING (region_no)"""
)
def region_status(spark: SparkSession, sf: str) -> DataFrame:
    """What of each region's package is there."""
    k = F.col("s_suppkey")
    files = table(spark, sf, "supplier").select((k * 5 % 27).cast("int").alias("region_no"), F.array(*map(F.lit, _ARTEFACTS))[(k % 5).cast("int")].alias("artefact"), (k * 1000).cast("long").alias("bytes"))
    return store.package_status(r.regions(spark), files)
