"""Further registered queries: tags to roads and places, route requests, regions, guidance, rings, stored tables; each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import draws, geo, roads, text
from wayfold.operators import matching, navigation, polygons, routing, spatial, store, tiles, tracks, ways
from wayfold.plans import oracles as o
from wayfold.session import table
from wayfold.sources import geo_tables as g
from wayfold.sources import regions as r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Scalars ------------------------------------------------------------------------------------------

_LAGGED = f"""{o.TRACK}, b AS (SELECT trip, seq, lat_e7 / 1e7 AS la, lon_e7 / 1e7 AS lo, lag(lat_e7) OVER w / 1e7 AS pa, lag(lon_e7) OVER w / 1e7 AS po, heading_deg::DOUBLE AS h, lag(heading_deg) OVER w::DOUBLE AS ph, (event_id % 11) / 10.0::DOUBLE AS alpha FROM track WINDOW w AS (PARTITION BY trip ORDER BY seq))"""


@query(
    f"""WITH {_LAGGED}, c AS (SELECT *, power(sin(radians(la - pa) / 2), 2) + cos(radians(pa)) * cos(radians(la)) * power(sin(radians(lo - po) / 2), 2) AS q,
    CASE WHEN h - ph > 180 THEN h - ph - 360 WHEN h - ph < -180 THEN h - ph + 360 ELSE h - ph END AS turn FROM b WHERE pa IS NOT NULL)
    SELECT trip, seq::INT AS seq, round(2 * 6371008.8 * asin(sqrt(q)), 3) AS metres, round((ph + turn * alpha) - 360 * floor((ph + turn * alpha) / 360), 6) AS blended,
    round(la + cos(radians(h + 90)) * 12.5 / (6371008.8::DOUBLE * 3.141592653589793::DOUBLE / 180), 8) AS side_lat, round(lo + sin(radians(h + 90)) * 12.5 / (6371008.8::DOUBLE * 3.141592653589793::DOUBLE / 180 * cos(radians(la))), 8) AS side_lon,
    round(la, 8) AS back_lat, round(lo, 8) AS back_lon FROM c"""
)
def geo_variants(spark: SparkSession, sf: str) -> DataFrame:
    """The arc sine distance, blended headings, the point beside, and the inverse of the map projection."""
    order = Window.partitionBy("trip").orderBy("seq")
    rows = g.track(spark, sf).select(
        "trip", "seq", (F.col("lat_e7") / 1e7).alias("la"), (F.col("lon_e7") / 1e7).alias("lo"), (F.lag("lat_e7").over(order) / 1e7).alias("pa"), (F.lag("lon_e7").over(order) / 1e7).alias("po"),
        F.col("heading_deg").cast("double").alias("h"), F.lag("heading_deg").over(order).cast("double").alias("ph"), ((F.col("event_id") % 11) / 10.0).alias("alpha"),
    ).filter("pa IS NOT NULL")
    la, lo, h = F.col("la"), F.col("lo"), F.col("h")
    side_lat, side_lon = geo.beside(la, lo, h, F.lit(12.5))
    return rows.select(
        "trip", "seq", F.round(geo.haversine_asin_m(F.col("pa"), F.col("po"), la, lo), 3).alias("metres"), F.round(geo.heading_blend_deg(F.col("ph"), h, F.col("alpha")), 6).alias("blended"),
        F.round(side_lat, 8).alias("side_lat"), F.round(side_lon, 8).alias("side_lon"), F.round(geo.mercator_lat(geo.mercator_y(la)), 8).alias("back_lat"), F.round(geo.mercator_lon(geo.mercator_x(lo)), 8).alias("back_lon"),
    )


@query(
    f"""WITH {o.NODES}, t AS (SELECT node_id, {o.MERC_X} AS x, {o.MERC_Y} AS y FROM nodes), k AS (SELECT *, floor(x * 4096)::BIGINT AS tx, floor(y * 4096)::BIGINT AS ty FROM t),
    q AS (SELECT *, round((x * 4096 - tx) * 65535)::INT AS qx, round((x * 4096 - tx + 0.001953125) / (1 + 2 * 0.001953125) * 65535)::INT AS bx FROM k)
    SELECT node_id, (12::BIGINT << 58) | (tx << 29) | ty AS key, 12 AS zoom, tx::INT AS tile_x, ty::INT AS tile_y, qx, bx, round((tx + qx / 65535.0::DOUBLE) / 4096, 10) AS back,
    round((tx + bx / 65535.0::DOUBLE * (1 + 2 * 0.001953125::DOUBLE) - 0.001953125::DOUBLE) / 4096, 10) AS buffered_back FROM q"""
)
def tile_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Packed tile keys, and coordinates quantised inside their tiles and taken back."""
    x, y, z = geo.mercator_x(F.col("lon_e7") / 1e7), geo.mercator_y(F.col("lat_e7") / 1e7), F.lit(12)
    rows = g.nodes(spark, sf).select("node_id", x.alias("x"), geo.tile_key(z, geo.tile(x, z), geo.tile(y, z)).alias("key"))
    zoom, tx, ty = geo.tile_of_key(F.col("key"))
    rows = rows.withColumns({"zoom": zoom, "tile_x": tx, "tile_y": ty})
    buffer = 0.5 / 256
    rows = rows.withColumns({"qx": geo.quantize(F.col("x"), F.col("tile_x"), z), "bx": geo.quantize(F.col("x"), F.col("tile_x"), z, buffer)})
    return rows.withColumns({"back": F.round(geo.dequantize(F.col("qx"), F.col("tile_x"), z), 10), "buffered_back": F.round(geo.dequantize(F.col("bx"), F.col("tile_x"), z, buffer), 10)}).drop("x")


@query(
    f"""WITH RECURSIVE {o.NODES}, s AS (SELECT max(lat_e7) - min(lat_e7) AS la, max(lon_e7) - min(lon_e7) AS lo FROM nodes), c AS (SELECT 100000::BIGINT << k AS size FROM range(20) t(k)),
    f AS (SELECT min(size) AS cell_e7 FROM c, s WHERE (la // size + 1) * (lo // size + 1) <= 2000000) SELECT cell_e7, la // cell_e7 + 1 AS n_rows, lo // cell_e7 + 1 AS n_columns FROM f, s"""
)
def grid_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The grid over all nodes: the cell's size, rows and columns."""
    span = g.nodes(spark, sf).agg((F.max("lat_e7") - F.min("lat_e7")).alias("la"), (F.max("lon_e7") - F.min("lon_e7")).alias("lo"))
    size = span.withColumn("cell_e7", geo.grid_cell_e7(F.col("la"), F.col("lo")))
    count = lambda c: (F.floor(F.col(c) / F.col("cell_e7")) + 1).cast("long")
    return size.select("cell_e7", count("la").alias("n_rows"), count("lo").alias("n_columns"))


@query(
    """WITH RECURSIVE w(s_suppkey, nth, x) AS (SELECT s_suppkey, 0, CASE WHEN s_suppkey = 0 THEN 1831565813 ELSE s_suppkey END::BIGINT FROM supplier UNION ALL
    SELECT s_suppkey, nth + 1, xor(c, (c << 5) & 4294967295) FROM (SELECT s_suppkey, nth, xor(b, b >> 17) AS c FROM (SELECT s_suppkey, nth, xor(x, (x << 13) & 4294967295) AS b FROM w WHERE nth < 5)))
    SELECT s_suppkey, nth, x AS state, round((x & 16777215) / 16777215.0::DOUBLE, 9) AS unit FROM w WHERE nth > 0"""
)
def random_units(spark: SparkSession, sf: str) -> DataFrame:
    """Five steps of a 32-bit xorshift generator from each supplier's number; a seed of 0 is replaced."""
    drawn = table(spark, sf, "supplier").withColumn("s", draws.states(F.col("s_suppkey"), 5))
    return drawn.select("s_suppkey", F.posexplode("s").alias("nth", "state")).select("s_suppkey", (F.col("nth") + 1).alias("nth"), "state", F.round(draws.unit(F.col("state")), 9).alias("unit"))


# Roads from tagged ways ---------------------------------------------------------------------------

_HIGHWAYS = ("primary", "secondary_link", "residential", "path", "track", "steps", "motorway", "road", "service")


def _pick(key, values: tuple) -> F.Column:
    return F.array(*[F.lit(v).cast("string") for v in values])[(key % len(values)).cast("int")]


def _tags(pairs: dict) -> F.Column:
    """A map of the tags that are not null."""
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*pairs.values())), lambda k, v: v.isNotNull())


def _ways(spark: SparkSession, sf: str) -> DataFrame:
    """Tagged ways over the line items of orders: (id, tags, refs); some references have no node."""
    k = F.col("id")
    when = lambda n, value: F.when(k % n == 0, value)
    tags = _tags({
        "highway": _pick(k, _HIGHWAYS), "oneway": _pick(k, ("yes", "-1", "no", None, None, None, None)), "access": _pick(k, ("no", "private", None, None, None, None, None, None, None, None, None)),
        "motor_vehicle": _pick(k, ("yes", None, None, None, None)), "surface": _pick(k, ("asphalt", "gravel", "sett", None, "moss", "sand")), "maxspeed": _pick(k, ("50", "30 mph", "walk", None)),
        "toll": when(13, "yes"), "junction": when(17, "roundabout"), "route": when(19, "ferry"),
    })
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 1600).alias("ref")))).alias("r"))
    return items.select("id", tags.alias("tags"), F.transform("r", lambda x: x["ref"]).alias("refs"))


_LIST = lambda values: "list_value(" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + ")"
_WAYS = f"""{o.NODES}, items AS (SELECT l_orderkey AS id, list((l_partkey * 7 + l_suppkey) % 1600 ORDER BY l_linenumber, (l_partkey * 7 + l_suppkey) % 1600) AS refs FROM lineitem GROUP BY 1),
tagged AS (SELECT *, {_LIST(_HIGHWAYS)}[1 + id % 9] AS highway, {_LIST(("yes", "-1", "no", None, None, None, None))}[1 + id % 7] AS oneway, {_LIST(("no", "private", *[None] * 9))}[1 + id % 11] AS access,
 {_LIST(("yes", None, None, None, None))}[1 + id % 5] AS motor, {_LIST(("asphalt", "gravel", "sett", None, "moss", "sand"))}[1 + id % 6] AS surf, {_LIST(("50", "30 mph", "walk", None))}[1 + id % 4] AS speed,
 id % 13 = 0 AS toll, id % 17 = 0 AS round_, id % 19 = 0 AS ferry FROM items),
routable AS (SELECT *, CASE WHEN ferry THEN 12 ELSE CASE highway WHEN 'motorway' THEN 1 WHEN 'primary' THEN 3 WHEN 'secondary_link' THEN 4 WHEN 'road' THEN 6 WHEN 'residential' THEN 7 WHEN 'service' THEN 8 WHEN 'track' THEN 10 WHEN 'path' THEN 11 ELSE 0 END END AS road_class,
 CASE surf WHEN 'asphalt' THEN 2 WHEN 'gravel' THEN 7 WHEN 'sett' THEN 4 WHEN 'moss' THEN 12 WHEN 'sand' THEN 10 ELSE 0 END AS surface, CASE speed WHEN '50' THEN 50 WHEN '30 mph' THEN 48 ELSE 0 END AS max_speed_kph,
 CASE WHEN oneway = 'yes' THEN 'forward' WHEN oneway = '-1' THEN 'backward' WHEN oneway = 'no' THEN 'both' WHEN round_ OR highway = 'motorway' THEN 'forward' ELSE 'both' END AS direction FROM tagged
 WHERE len(refs) >= 2 AND NOT coalesce(coalesce(motor, access) IN ('no', 'private'), false)),
open_ AS (SELECT *, toll::INT + 2 * ferry::INT + 4 * (surface BETWEEN 5 AND 11)::INT AS flags FROM routable WHERE road_class > 0 AND (road_class <> 11 OR motor = 'yes'))"""


@query(
    f"""WITH {_WAYS}, pairs AS (SELECT *, unnest(range(len(refs) - 1)) AS pos FROM open_), p AS (SELECT *, refs[pos + 1] AS a, refs[pos + 2] AS b FROM pairs),
    e AS (SELECT p.*, round({o.hav("x.lat_e7 / 1e7", "x.lon_e7 / 1e7", "y.lat_e7 / 1e7", "y.lon_e7 / 1e7")} * 100)::BIGINT AS length_cm FROM p JOIN nodes x ON x.node_id = a JOIN nodes y ON y.node_id = b WHERE a <> b)
    SELECT id AS way_id, pos::INT AS pos, a AS src, b AS dst, road_class, surface, flags, max_speed_kph, length_cm FROM e WHERE direction <> 'backward' UNION ALL
    SELECT id, pos::INT, b, a, road_class, surface, flags, max_speed_kph, length_cm FROM e WHERE direction <> 'forward'"""
)
def way_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The directed edges of all routable ways."""
    return ways.edges(_ways(spark, sf), g.nodes(spark, sf).withColumnRenamed("node_id", "id"))


@query(
    f"""WITH {_WAYS}, refs_ AS (SELECT DISTINCT unnest(refs) AS id FROM open_) SELECT (SELECT count(*) FROM items) AS ways, (SELECT count(*) FROM open_) AS routable,
    (SELECT count(*) FROM refs_) AS referenced, (SELECT count(*) FROM refs_ JOIN nodes ON node_id = id) AS found"""
)
def import_counters(spark: SparkSession, sf: str) -> DataFrame:
    """How many ways, routable ways, nodes they reference, and of these found."""
    return ways.counters(_ways(spark, sf), g.nodes(spark, sf).withColumnRenamed("node_id", "id"))


_KINDS = ("water", "green", "built_up", "building", "river", "primary")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """Map features over the ways: an area tag, a waterway or a road by the way's number; every fourth one closes."""
    rows = _ways(spark, sf).select("id", F.when(F.col("id") % 4 == 0, F.concat("refs", F.slice("refs", 1, 1))).otherwise(F.col("refs")).alias("refs"))
    k = F.col("id")
    tags = _tags({
        "natural": _pick(k, ("water", "wood", None, None, None, "coastline", None)), "landuse": _pick(k, (None, None, "retail", None, None, None, "basin")),
        "building": _pick(k, (None, None, None, "yes", None)), "waterway": _pick(k, (None, None, None, None, "river", None, None, "ditch")), "highway": _pick(k, (None, None, None, None, None, "trunk_link", "primary")),
    })
    return rows.withColumn("tags", tags)


_FEATURES = f"""{o.NODES}, items AS (SELECT l_orderkey AS id, list((l_partkey * 7 + l_suppkey) % 1600 ORDER BY l_linenumber, (l_partkey * 7 + l_suppkey) % 1600) AS r FROM lineitem GROUP BY 1),
closed AS (SELECT id, CASE WHEN id % 4 = 0 THEN list_append(r, r[1]) ELSE r END AS refs, {_LIST(("water", "wood", None, None, None, "coastline", None))}[1 + id % 7] AS nat, {_LIST((None, None, "retail", None, None, None, "basin"))}[1 + id % 7] AS land,
 {_LIST((None, None, None, "yes", None))}[1 + id % 5] AS house, {_LIST((None, None, None, None, "river", None, None, "ditch"))}[1 + id % 8] AS stream, {_LIST((None, None, None, None, None, "trunk_link", "primary"))}[1 + id % 7] AS road FROM items),
kinds AS (SELECT *, CASE WHEN nat = 'water' OR land = 'basin' THEN 'water' WHEN nat = 'wood' THEN 'green' WHEN land = 'retail' THEN 'built_up' WHEN house = 'yes' THEN 'building' END AS area,
 CASE stream WHEN 'river' THEN 'river' WHEN 'ditch' THEN 'drain' END AS water_line, CASE WHEN nat = 'coastline' THEN 'coastline' WHEN road = 'trunk_link' THEN 'trunk' WHEN road = 'primary' THEN 'primary' END AS overview FROM closed),
kept AS (SELECT id, coalesce(area, water_line, overview) AS kind, CASE WHEN area = 'building' AND refs[1] = refs[-1] AND coalesce(land, '') <> 'retail' THEN refs[1:1] ELSE refs END AS refs FROM kinds WHERE coalesce(area, water_line, overview) IS NOT NULL)"""


@query(
    f"""WITH {_FEATURES}, e AS (SELECT id, kind, len(refs) AS n, unnest(refs) AS ref FROM kept), f AS (SELECT id, kind, any_value(n) AS n, count(*) AS found, sum(lat_e7)::BIGINT AS lat_sum FROM e JOIN nodes ON node_id = ref GROUP BY 1, 2)
    SELECT id, kind, n AS n_points, lat_sum FROM f WHERE found = n AND CASE WHEN kind IN ('river', 'drain', 'coastline', 'trunk', 'primary') THEN n >= 2 ELSE n >= 4 OR (kind = 'building' AND n = 1) END"""
)
def map_features(spark: SparkSession, sf: str) -> DataFrame:
    """Areas, waterways and overview lines by their tags, with the places of their nodes; incomplete and too short ones dropped."""
    rows, t = _features(spark, sf), F.col("tags")
    kind = F.coalesce(ways.area_kind(t), ways.waterway_kind(t), ways.overview_kind(t))
    kept = rows.withColumn("kind", kind).filter("kind IS NOT NULL").select("id", "kind", ways.stored_refs(F.col("kind"), t, F.col("refs")).alias("refs"))
    found = ways.located(kept, g.nodes(spark, sf).withColumnRenamed("node_id", "id"))
    return found.select("id", "kind", F.size("points").cast("long").alias("n_points"), F.aggregate("points", F.lit(0).cast("long"), lambda s, p: s + p["lat_e7"]).alias("lat_sum"))


@query(
    f"""WITH {_WAYS}, m AS (SELECT s_suppkey AS relation, ['outer', 'inner', ''][1 + k % 3] AS role, s_suppkey * 7 + k * 11 AS way FROM supplier, (SELECT unnest(range(6)) AS k))
    SELECT relation, role, way, len(refs) AS n_refs FROM m JOIN items ON id = way"""
)
def relation_members(spark: SparkSession, sf: str) -> DataFrame:
    """The member ways of relations that are there."""
    member = lambda k: F.struct(F.when(k % 2 >= 0, "way").alias("type"), (F.col("s_suppkey") * 7 + k * 11).alias("ref"), _pick(k, ("outer", "inner", "")).alias("role"))
    relations = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(5)), member).alias("members"))
    return ways.members(relations, _ways(spark, sf)).select("relation", "role", "way", F.size("refs").cast("long").alias("n_refs"))


_PLACE_TAGS = f"""tagged AS (SELECT p_partkey % (SELECT count(*) * 3 // 4 FROM part) AS id, p_partkey AS version, CASE WHEN p_partkey % 17 = 0 THEN '--' ELSE p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' É' END AS french,
 {_LIST(("city", "town", "village", "hamlet", "suburb", None, "farm"))}[1 + p_partkey % 7] AS place, {_LIST(("fuel", None, "bank"))}[1 + p_partkey % 3] AS amenity, {_LIST(("viewpoint", None))}[1 + p_partkey % 2] AS tourism,
 CASE WHEN p_partkey % 3 > 0 THEN (p_partkey * 37 % 200000)::VARCHAR END AS people, (420000000 + (p_partkey * 6007 % 90000) * 1000)::BIGINT AS lat_e7, (-45000000 + (p_partkey * 99991 % 120000) * 1000)::BIGINT AS lon_e7 FROM part),
kinds AS (SELECT *, CASE WHEN place IN ('city', 'town', 'village', 'hamlet', 'suburb') THEN place WHEN amenity = 'fuel' THEN 'fuel' WHEN tourism = 'viewpoint' THEN 'viewpoint' END AS what, coalesce(french, name) AS shown FROM tagged),
ranked AS (SELECT *, CASE what WHEN 'city' THEN 1 WHEN 'town' THEN 2 WHEN 'village' THEN 3 WHEN 'hamlet' THEN 4 WHEN 'suburb' THEN 5 WHEN 'fuel' THEN 7 WHEN 'viewpoint' THEN 9 END AS kind,
 CASE what WHEN 'city' THEN 1000 WHEN 'town' THEN 850 WHEN 'village' THEN 700 WHEN 'hamlet' THEN 500 WHEN 'suburb' THEN 420 WHEN 'fuel' THEN 620 WHEN 'viewpoint' THEN 480 END AS base, {o.normalized("shown")} AS normalized, coalesce(people, '0')::BIGINT AS pop FROM kinds WHERE what IS NOT NULL),
found AS (SELECT *, CASE WHEN base >= 700 THEN base + least(180, CASE WHEN pop > 0 THEN (length(pop::VARCHAR) - 1) * 20 ELSE 0 END) ELSE base END::INT AS rank FROM ranked WHERE normalized IS NOT NULL),
places AS (SELECT id, arg_max(shown, version) AS name, arg_max(normalized, version) AS normalized, arg_max(kind, version) AS kind, arg_max(rank, version) AS rank, arg_max(lat_e7, version) AS lat_e7, arg_max(lon_e7, version) AS lon_e7 FROM found GROUP BY id)"""


def _tagged_places(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    n = parts.agg(F.floor(F.count("*") * 3 / 4).alias("n"))
    k, name = F.col("p_partkey"), F.col("p_name")
    tags = _tags({
        "name": F.when(k % 17 == 0, "--").otherwise(name), "name:fr": F.when(k % 5 == 0, F.concat(name, F.lit(" É"))), "place": _pick(k, ("city", "town", "village", "hamlet", "suburb", None, "farm")),
        "amenity": _pick(k, ("fuel", None, "bank")), "tourism": _pick(k, ("viewpoint", None)), "population": F.when(k % 3 > 0, (k * 37 % 200000).cast("string")),
    })
    lat, lon = (F.lit(420000000) + (k * 6007 % 90000) * 1000).cast("long"), (F.lit(-45000000) + (k * 99991 % 120000) * 1000).cast("long")
    return parts.crossJoin(F.broadcast(n)).select((k % F.col("n")).alias("id"), k.alias("version"), tags.alias("tags"), lat.alias("lat_e7"), lon.alias("lon_e7"))  # one row on the right


@query(f"WITH {_PLACE_TAGS} SELECT * FROM places")
def places_from_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Named places of tagged nodes, the last version of each."""
    return ways.places(_tagged_places(spark, sf))


@query(
    f"""WITH {_PLACE_TAGS}, l AS (SELECT *, CASE kind WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 5 THEN 3 ELSE 4 END AS lod FROM places WHERE kind BETWEEN 1 AND 6)
    SELECT id, lod, kind, rank, row_number() OVER (PARTITION BY lod ORDER BY rank DESC, id)::INT AS ordinal FROM l"""
)
def map_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of settlements with their level of detail, numbered by rank within it."""
    rows = ways.places(_tagged_places(spark, sf)).filter("kind BETWEEN 1 AND 6").withColumn("lod", text.label_zoom(F.col("kind")))
    return spatial.numbered(rows.select("id", "lod", "kind", "rank"), "lod", F.col("rank"), F.col("id"), F.floor(F.col("id") / 4096)).select("id", "lod", "kind", "rank", F.col("nth").cast("int").alias("ordinal"))


# Graph and routes ---------------------------------------------------------------------------------


@query(f"WITH {o.EDGES} SELECT row_number() OVER (ORDER BY src, dst, edge_id) - 1 AS place, src, dst, edge_id FROM edges")
def edges_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """All edges with their place in the order of (src, dst)."""
    return spatial.sorted_edges(g.edges(spark, sf))


@query(
    f"""WITH {o.EDGES}, z AS (SELECT unnest([8, 10, 12, 14]) AS zoom), v AS (SELECT zoom, road_class, CASE WHEN road_class <= 3 THEN 10 WHEN road_class <= 5 THEN 12 ELSE 14 END AS owner FROM edges, z
    WHERE road_class <= CASE zoom WHEN 8 THEN 2 WHEN 10 THEN 3 WHEN 12 THEN 5 ELSE 12 END) SELECT zoom, count(*) AS visible, count(*) FILTER (owner = zoom) AS owned FROM v GROUP BY 1"""
)
def roads_by_zoom(spark: SparkSession, sf: str) -> DataFrame:
    """How many edges are drawn at each zoom, and how many its tiles hold."""
    rows = g.edges(spark, sf).withColumn("zoom", F.explode(F.array(*map(F.lit, (8, 10, 12, 14))))).filter(roads.visible(F.col("road_class"), F.col("zoom")))
    return rows.groupBy("zoom").agg(F.count("*").alias("visible"), F.count_if(roads.owner_zoom(F.col("road_class")) == F.col("zoom")).alias("owned"))


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, cost, length_cm, time_ms): the cheapest of parallel edges for touring."""
    rows = roads.edge_costs(g.edges(spark, sf)).filter("profile = 'TOURING'").withColumns({"ms": F.round(F.col("cost") * 1000).cast("long"), "time_ms": F.round(F.col("seconds") * 1000).cast("long")})
    best = rows.groupBy("src", "dst").agg(F.min(F.struct(F.col("ms").alias("cost"), "edge_id", "length_cm", "time_ms")).alias("b"))
    return best.select("src", "dst", "b.cost", "b.length_cm", "b.time_ms")


@query(None)
def route_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Ways between positions on edges, one request for each of 25 groups of edges: cost, length, time and end nodes."""
    e = g.edges(spark, sf)
    k = (F.col("edge_id") % 25).alias("request")
    ask = e.groupBy(k).agg(F.min_by(F.struct("src", "dst"), "edge_id").alias("s"), F.max_by(F.struct("src", "dst"), "edge_id").alias("g"))
    asked = ask.select("request", F.col("s.src").alias("start_a"), F.col("s.dst").alias("start_b"), (F.col("request") % 5 / 4.0).alias("start_fraction"), F.col("g.src").alias("goal_a"), F.col("g.dst").alias("goal_b"), ((F.col("request") + 2) % 5 / 4.0).alias("goal_fraction"))
    return routing.answered(asked, _priced(spark, sf))[0]


_ROUTE_SQL = f"""WITH RECURSIVE {o.COSTS}, priced AS (SELECT *, round(cost * 1000)::BIGINT AS ms, round(seconds * 1000)::BIGINT AS s_ms FROM costs WHERE profile = 'TOURING'),
arcs AS (SELECT src, dst, min(ms) AS c, arg_min(length_cm, (ms, edge_id)) AS l, arg_min(s_ms, (ms, edge_id)) AS t FROM priced GROUP BY src, dst),
ask AS (SELECT (edge_id % 25)::BIGINT AS request, arg_min(src, edge_id) AS sa, arg_min(dst, edge_id) AS sb, arg_max(src, edge_id) AS ga, arg_max(dst, edge_id) AS gb FROM edges GROUP BY 1),
asked AS (SELECT *, (request % 5) / 4.0::DOUBLE AS sf, ((request + 2) % 5) / 4.0::DOUBLE AS gf FROM ask),
so AS (SELECT request, sa AS node, sb AS src, sa AS dst, sf AS share FROM asked UNION ALL SELECT request, sb, sa, sb, 1 - sf FROM asked),
go AS (SELECT request, ga AS node, ga AS src, gb AS dst, gf AS share FROM asked UNION ALL SELECT request, gb, gb, ga, 1 - gf FROM asked),
starts AS (SELECT request, node, CASE WHEN share = 0 THEN 0 ELSE round(c * share) END::BIGINT AS c, CASE WHEN share = 0 THEN 0 ELSE round(l * share) END::BIGINT AS l, CASE WHEN share = 0 THEN 0 ELSE round(t * share) END::BIGINT AS t FROM so LEFT JOIN arcs USING (src, dst) WHERE share = 0 OR c IS NOT NULL),
goals AS (SELECT request, node, CASE WHEN share = 0 THEN 0 ELSE round(c * share) END::BIGINT AS c, CASE WHEN share = 0 THEN 0 ELSE round(l * share) END::BIGINT AS l, CASE WHEN share = 0 THEN 0 ELSE round(t * share) END::BIGINT AS t FROM go LEFT JOIN arcs USING (src, dst) WHERE share = 0 OR c IS NOT NULL),
walk(request, node, cost) USING KEY (request, node) AS (SELECT request, node, min(c) FROM starts GROUP BY ALL
  UNION (SELECT w.request, a.dst, min(w.cost + a.c) FROM walk w JOIN arcs a ON a.src = w.node LEFT JOIN recurring.walk r ON r.request = w.request AND r.node = a.dst WHERE r.cost IS NULL OR w.cost + a.c < r.cost GROUP BY ALL)),
via AS (SELECT w.request, w.node, min(a.src) AS via FROM walk w JOIN arcs a ON a.dst = w.node JOIN walk p ON p.request = w.request AND p.node = a.src AND p.cost + a.c = w.cost
  WHERE NOT EXISTS (SELECT 1 FROM starts s WHERE s.request = w.request AND s.node = w.node AND s.c = w.cost) GROUP BY ALL),
best AS (SELECT request, min(w.cost + q.c) AS cost, arg_min(node, (w.cost + q.c, node)) AS goal FROM walk w JOIN goals q USING (request, node) GROUP BY 1),
path(request, node, l, t) AS (SELECT request, goal, 0::BIGINT, 0::BIGINT FROM best UNION ALL SELECT p.request, v.via, p.l + a.l, p.t + a.t FROM path p JOIN via v USING (request, node) JOIN arcs a ON a.src = v.via AND a.dst = p.node),
done AS (SELECT p.request, p.node AS start, b.goal, b.cost, p.l + s.l + q.l AS length_cm, p.t + s.t + q.t AS time_ms FROM path p JOIN best b USING (request) JOIN starts s ON s.request = p.request AND s.node = p.node JOIN goals q ON q.request = b.request AND q.node = b.goal
  WHERE NOT EXISTS (SELECT 1 FROM via v WHERE v.request = p.request AND v.node = p.node)),
same AS (SELECT *, CASE WHEN ga = sa THEN gf ELSE 1 - gf END - sf AS delta FROM asked WHERE least(sa, sb) = least(ga, gb) AND greatest(sa, sb) = greatest(ga, gb)),
along AS (SELECT s.request, delta, a.* FROM same s LEFT JOIN arcs a ON a.src = CASE WHEN delta > 0 THEN sa ELSE sb END AND a.dst = CASE WHEN delta > 0 THEN sb ELSE sa END WHERE a.c IS NOT NULL OR abs(delta) < 1e-12),
every AS (SELECT request, false AS direct, start, goal, cost, length_cm, time_ms FROM done UNION ALL SELECT request, true, NULL, NULL, CASE WHEN abs(delta) < 1e-12 THEN 0 ELSE round(c * abs(delta)) END::BIGINT, CASE WHEN abs(delta) < 1e-12 THEN 0 ELSE round(l * abs(delta)) END::BIGINT, CASE WHEN abs(delta) < 1e-12 THEN 0 ELSE round(t * abs(delta)) END::BIGINT FROM along)
SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY request ORDER BY cost, direct DESC) = 1"""
ORACLES["route_requests"] = _ROUTE_SQL


# Regions ------------------------------------------------------------------------------------------

_REGIONS = ", ".join(f"({k}, '{name}', {lat}::DOUBLE, {lon}::DOUBLE)" for k, (name, lat, lon) in enumerate(r.REGIONS))
_NO = {name: k for k, (name, _, _) in enumerate(r.REGIONS)}
_NEAR = ", ".join(f"({_NO[a]}, {_NO[b]})" for a, names in r.NEIGHBOURS.items() for b in names.split())
_PLAN_SQL = f"""regions AS (SELECT * FROM (VALUES {_REGIONS}) t(region_no, region, lat, lon)), half AS (SELECT * FROM (VALUES {_NEAR}) t(a, b)), near AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
requests AS (SELECT n_nationkey::BIGINT AS request, (n_nationkey % 27)::INT AS from_no, ((n_nationkey * 7 + 3) % 27)::INT AS to_no FROM nation),
places AS (SELECT q.*, f.lat + 0.1 AS from_lat, f.lon - 0.1 AS from_lon, t.lat - 0.2 AS to_lat, t.lon + 0.05 AS to_lon FROM requests q JOIN regions f ON f.region_no = from_no JOIN regions t ON t.region_no = to_no),
located AS (SELECT request, region_no, CASE WHEN region_no = from_no THEN from_lat WHEN region_no = to_no THEN to_lat ELSE lat END AS lat, CASE WHEN region_no = from_no THEN from_lon WHEN region_no = to_no THEN to_lon ELSE lon END AS lon FROM places p, regions),
arcs AS (SELECT x.request, a, b, round({o.hav("x.lat", "x.lon", "y.lat", "y.lon")} * 100)::BIGINT AS c FROM near JOIN located x ON x.region_no = a JOIN located y ON y.region_no = b AND y.request = x.request {{keep}}),
walk(request, node, cost) USING KEY (request, node) AS (SELECT request, from_no, 0::BIGINT FROM requests {{start}}
  UNION (SELECT w.request, a.b, min(w.cost + a.c) FROM walk w JOIN arcs a ON a.request = w.request AND a.a = w.node LEFT JOIN recurring.walk k ON k.request = w.request AND k.node = a.b WHERE k.cost IS NULL OR w.cost + a.c < k.cost GROUP BY ALL)),
via AS (SELECT w.request, w.node, min(a.a) AS via FROM walk w JOIN arcs a ON a.request = w.request AND a.b = w.node JOIN walk p ON p.request = w.request AND p.node = a.a AND p.cost + a.c = w.cost WHERE w.cost > 0 GROUP BY ALL),
path(request, hop, region_no) AS (SELECT request, 0, to_no FROM requests JOIN walk USING (request) WHERE node = to_no UNION ALL SELECT p.request, p.hop + 1, v.via FROM path p JOIN via v ON v.request = p.request AND v.node = p.region_no)"""


def _plan_requests(spark: SparkSession, sf: str) -> DataFrame:
    c, k = r.regions(spark), F.col("n_nationkey")
    rows = table(spark, sf, "nation").select(k.cast("long").alias("request"), (k % 27).cast("int").alias("from_no"), ((k * 7 + 3) % 27).cast("int").alias("to_no"))
    ends = lambda side, dy, dx: F.broadcast(c.select(F.col("region_no").alias(f"{side}_no"), (F.col("lat") + dy).alias(f"{side}_lat"), (F.col("lon") + dx).alias(f"{side}_lon")))
    return rows.join(ends("from", 0.1, -0.1), "from_no").join(ends("to", -0.2, 0.05), "to_no")


@query(f"WITH RECURSIVE {_PLAN_SQL.format(keep='', start='')} SELECT request, hop, region_no, region_no % 4 = 0 AS missing FROM path")
def region_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The regions that a way between two positions crosses, and which of them are not installed."""
    plan = routing.region_plans(_plan_requests(spark, sf), r.regions(spark), r.neighbours(spark))
    absent = r.regions(spark).filter("region_no % 4 = 0").select("region_no", F.lit(True).alias("missing"))
    return plan.join(F.broadcast(absent), "region_no", "left").select("request", "hop", "region_no", F.coalesce("missing", F.lit(False)).alias("missing"))


@query(f"WITH RECURSIVE {_PLAN_SQL.format(keep='WHERE a % 4 <> 0 AND b % 4 <> 0', start='WHERE from_no % 4 <> 0 AND to_no % 4 <> 0')} SELECT request, hop, region_no FROM path")
def region_plan_installed(spark: SparkSession, sf: str) -> DataFrame:
    """The same over installed regions only, for requests whose ends are installed."""
    return routing.region_plans(_plan_requests(spark, sf), r.regions(spark), r.neighbours(spark), r.regions(spark).filter("region_no % 4 <> 0"))


_SQUARES = """squares AS (SELECT n_nationkey AS region, n_nationkey % 5 AS cx, n_nationkey // 5 AS cy FROM nation), corner AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) t(seq, dx, dy)),
rings AS (SELECT region, 0 AS ring, false AS hole, seq, -4.5 + cx * 2.4 + dx * 2.6 AS x, 42 + cy * 1.8 + dy * 2.0 + dx * 0.1 AS y FROM squares, corner UNION ALL SELECT region, 1, true, seq, -3.7 + cx * 2.4 + dx * 0.8, 42.6 + cy * 1.8 + dy * 0.7 FROM squares, corner)"""


@query(
    f"""WITH {o.POINTS}, {_SQUARES}, s AS (SELECT *, lead(x) OVER w AS nx0, lead(y) OVER w AS ny0, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM rings WINDOW w AS (PARTITION BY region, ring ORDER BY seq)),
    e AS (SELECT region, ring, hole, x AS x1, y AS y1, coalesce(nx0, fx) AS x2, coalesce(ny0, fy) AS y2 FROM s), p AS (SELECT point_id, lon_e7 / 1e7 AS px, lat_e7 / 1e7 AS py FROM points),
    c AS (SELECT point_id, region, ring, hole, count(*) AS n FROM p JOIN e ON (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
    k AS (SELECT point_id, region FROM c GROUP BY ALL HAVING NOT bool_or(hole)) SELECT point_id, min(region) AS region FROM k GROUP BY 1"""
)
def regions_of_points(spark: SparkSession, sf: str) -> DataFrame:
    """The first region whose outline holds a point, holes excluded."""
    k = F.col("s_suppkey")
    points = table(spark, sf, "supplier").select(k.alias("point_id"), ((F.lit(-45000000) + (k * 98953 % 120000) * 1000 + 411) / 1e7).alias("x"), ((F.lit(420000000) + (k * 6151 % 90000) * 1000 + 137) / 1e7).alias("y"))
    n = F.col("n_nationkey")
    corner = F.explode(F.array(*[F.struct(F.lit(s).alias("seq"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for s, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]))
    squares = table(spark, sf, "nation").select(n.alias("region"), (n % 5).alias("cx"), F.floor(n / 5).alias("cy"), corner.alias("c")).select("region", "cx", "cy", "c.*")
    outer = squares.select("region", F.lit(0).alias("ring"), F.lit(False).alias("hole"), "seq", (F.lit(-4.5) + F.col("cx") * 2.4 + F.col("dx") * 2.6).alias("x"), (F.lit(42) + F.col("cy") * 1.8 + F.col("dy") * 2.0 + F.col("dx") * 0.1).alias("y"))
    inner = squares.select("region", F.lit(1), F.lit(True), "seq", (F.lit(-3.7) + F.col("cx") * 2.4 + F.col("dx") * 0.8).alias("x"), (F.lit(42.6) + F.col("cy") * 1.8 + F.col("dy") * 0.7).alias("y"))
    return ways.regions_of(points, outer.union(inner))


# Guidance -----------------------------------------------------------------------------------------


def _walks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Routes over a dense little graph: (route, pos, node, at_m) from line items, and its edges (src, dst, roundabout)."""
    order = Window.partitionBy("route").orderBy("l_linenumber", "l_partkey", "l_suppkey", "m")
    steps = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route"), "l_linenumber", "l_partkey", "l_suppkey", ((F.col("l_partkey") * 3 + F.col("l_suppkey")) % 40).cast("long").alias("node"), F.col("l_quantity").cast("double").alias("m"))
    rows = steps.select("route", (F.row_number().over(order) - 1).alias("pos"), "node", (F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("at_m"))
    after = rows.withColumn("dst", F.lead("node").over(Window.partitionBy("route").orderBy("pos"))).filter("dst IS NOT NULL AND dst <> node")
    edges = after.select(F.col("node").alias("src"), "dst").distinct().filter("(src * 7 + dst) % 9 < 8").withColumn("roundabout", (F.col("src") * 5 + F.col("dst") * 11) % 3 < 2)
    return rows, edges


_WALKS = """steps AS (SELECT l_orderkey AS route, row_number() OVER w - 1 AS pos, ((l_partkey * 3 + l_suppkey) % 40)::BIGINT AS node, sum(l_quantity::DOUBLE) OVER w AS at_m FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)),
hops AS (SELECT *, lag(node) OVER w AS before_, lead(node) OVER w AS after_ FROM steps WINDOW w AS (PARTITION BY route ORDER BY pos)),
edges AS (SELECT DISTINCT node AS src, after_ AS dst, (node * 5 + after_ * 11) % 3 < 2 AS roundabout FROM hops WHERE after_ IS NOT NULL AND after_ <> node AND (node * 7 + after_) % 9 < 8),
told AS (SELECT h.route, h.pos, h.node, any_value(h.at_m) AS at_m, coalesce(bool_or(e.dst <> coalesce(before_, -1) AND e.dst <> coalesce(after_, -1)), false) AS alternative, coalesce(bool_or(e.dst <> coalesce(before_, -1) AND NOT e.roundabout), false) AS exit,
  coalesce(bool_or(e.dst = coalesce(after_, -1) AND e.roundabout), false) AS out_roundabout FROM hops h LEFT JOIN edges e ON e.src = h.node GROUP BY h.route, h.pos, h.node),
context AS (SELECT *, coalesce(lag(out_roundabout) OVER w, false) AS into_roundabout, lead(pos) OVER w IS NULL AS last_ FROM told WINDOW w AS (PARTITION BY route ORDER BY pos))"""


@query(f"WITH {_WALKS} SELECT route, pos::INT AS pos, node, alternative, exit, out_roundabout, into_roundabout FROM context")
def route_context(spark: SparkSession, sf: str) -> DataFrame:
    """What each point of a route offers: roundabouts before and behind it, other ways, exits."""
    return navigation.context(*_walks(spark, sf)).select("route", "pos", "node", "alternative", "exit", "out_roundabout", "into_roundabout")


@query(
    f"""WITH {_WALKS}, runs AS (SELECT *, sum((out_roundabout AND NOT into_roundabout)::INT) OVER (PARTITION BY route ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM context)
    SELECT route, min(pos)::INT AS pos, count(*) FILTER ((into_roundabout AND out_roundabout AND exit OR into_roundabout AND NOT out_roundabout) AND NOT last_) AS exit_no, round(max(at_m), 2) AS done_at_m FROM runs WHERE out_roundabout OR into_roundabout GROUP BY route, run"""
)
def roundabout_exits(spark: SparkSession, sf: str) -> DataFrame:
    """The exit taken at each roundabout of each route, and where it is left behind."""
    found = navigation.roundabouts(navigation.context(*_walks(spark, sf)))
    return found.select("route", "pos", "exit_no", F.round("done_at_m", 2).alias("done_at_m"))


@query(
    f"""WITH {o.TRACK}, {o.STEPS}, w AS (SELECT trip, (seq - 1)::INT AS point, lat_e7 / 1e7 AS la, lon_e7 / 1e7 AS lo, sum(step_m) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING) AS m FROM stepped),
    n AS (SELECT *, coalesce(max(point) OVER (PARTITION BY trip ORDER BY m RANGE BETWEEN UNBOUNDED PRECEDING AND 30 PRECEDING), 0) AS a, coalesce(min(point) OVER (PARTITION BY trip ORDER BY m RANGE BETWEEN 30 FOLLOWING AND UNBOUNDED FOLLOWING), max(point) OVER (PARTITION BY trip)) AS b FROM w),
    t AS (SELECT n.trip, n.point, {o.bearing("x.la", "x.lo", "n.la", "n.lo")} AS i, {o.bearing("n.la", "n.lo", "y.la", "y.lo")} AS u FROM n JOIN w x ON x.trip = n.trip AND x.point = n.a JOIN w y ON y.trip = n.trip AND y.point = n.b WHERE n.a < n.point AND n.point < n.b),
    s AS (SELECT trip, point, CASE WHEN (u - i) - 360 * floor((u - i) / 360) > 180 THEN (u - i) - 360 * floor((u - i) / 360) - 360 ELSE (u - i) - 360 * floor((u - i) / 360) END AS turn FROM t)
    SELECT trip, point, round(turn, 4) AS turn, CASE WHEN abs(turn) < 25 THEN 'CONTINUE' WHEN abs(turn) >= 165 THEN 'UTURN' ELSE CASE WHEN abs(turn) < 55 THEN 'SLIGHT_' WHEN abs(turn) < 120 THEN '' ELSE 'SHARP_' END || CASE WHEN turn < 0 THEN 'LEFT' ELSE 'RIGHT' END END AS kind FROM s"""
)
def stable_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns by chords of at least 30 m before and behind each point."""
    way = tracks.cumulative(g.routes(spark, sf), "point")
    return navigation.stable_turns(way).withColumn("turn", F.round("turn", 4))


_MARKS = f"""{o.TRACK}, {o.STEPS}, marks AS (SELECT trip, (seq - 1)::INT AS point, sum(step_m) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING) AS at_m, CASE WHEN event_id % 5 = 0 THEN 'ROUNDABOUT' WHEN event_id % 3 = 0 THEN 'LEFT' ELSE 'CONTINUE' END AS kind, (event_id % 4)::INT AS exit_no FROM stepped)"""


def _marks(spark: SparkSession, sf: str) -> DataFrame:
    way = tracks.cumulative(g.track(spark, sf))
    kind = F.when(F.col("event_id") % 5 == 0, "ROUNDABOUT").when(F.col("event_id") % 3 == 0, "LEFT").otherwise("CONTINUE")
    return way.select("trip", (F.col("seq") - 1).alias("point"), F.col("total_m").alias("at_m"), kind.alias("kind"), (F.col("event_id") % 4).cast("int").alias("exit_no"))


@query(
    f"""WITH {_MARKS}, l AS (SELECT *, last_value(CASE WHEN kind <> 'CONTINUE' THEN kind END IGNORE NULLS) OVER w AS k, last_value(CASE WHEN kind <> 'CONTINUE' THEN at_m END IGNORE NULLS) OVER w AS m FROM marks WINDOW w AS (PARTITION BY trip ORDER BY point ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    kept AS (SELECT * FROM l WHERE NOT coalesce(kind = 'CONTINUE' AND k = 'ROUNDABOUT' AND at_m - m <= 120, false)),
    i AS (SELECT *, sum(CASE WHEN coalesce(kind = 'CONTINUE' AND lag_kind = 'CONTINUE' AND at_m - lag_m <= 300, false) THEN 0 ELSE 1 END) OVER (PARTITION BY trip ORDER BY point ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, lag(kind) OVER w AS lag_kind, lag(at_m) OVER w AS lag_m FROM kept WINDOW w AS (PARTITION BY trip ORDER BY point)))
    SELECT trip, point, kind, round(at_m, 2) AS at_m, CASE kind WHEN 'LEFT' THEN 'Tournez a gauche' WHEN 'CONTINUE' THEN 'Continuez tout droit' ELSE CASE WHEN exit_no > 0 THEN 'Au rond-point, prenez la sortie ' || exit_no ELSE 'Entrez dans le rond-point' END END AS spoken
    FROM i QUALIFY row_number() OVER (PARTITION BY trip, island ORDER BY point DESC) = 1"""
)
def instructions_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Instructions without needless CONTINUE rows, with what is said."""
    rows = navigation.compacted(_marks(spark, sf))
    return rows.select("trip", "point", "kind", F.round("at_m", 2).alias("at_m"), text.spoken(F.col("kind"), F.col("exit_no")).alias("spoken"))


@query(
    f"""WITH {_MARKS}, t AS (SELECT trip, max(at_m) AS g FROM marks GROUP BY 1) SELECT trip, point, round(CASE WHEN g > 0 THEN at_m * (g * (1 + trip % 7 / 100.0::DOUBLE) / g) ELSE at_m END, 2) AS at_m FROM marks JOIN t USING (trip) WHERE kind = 'LEFT'"""
)
def instructions_scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Left turns at their way on the routed length, which differs from the drawn one."""
    marks = _marks(spark, sf)
    totals = marks.groupBy("trip").agg(F.max("at_m").alias("geometry_m")).withColumn("route_m", F.col("geometry_m") * (1 + F.col("trip") % 7 / 100.0))
    return navigation.scaled(marks.filter("kind = 'LEFT'"), totals).select("trip", "point", F.round("at_m", 2).alias("at_m"))


@query(
    f"""WITH RECURSIVE {o.TRACK}, {o.STEPS}, w AS (SELECT trip, seq, sum(step_m) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING) AS m FROM stepped),
    f(trip, seq, last, kept) AS (SELECT trip, seq, m, true FROM w WHERE seq = 1 UNION ALL SELECT w.trip, w.seq, CASE WHEN w.m < f.last OR w.m - f.last >= 400 THEN w.m ELSE f.last END, w.m < f.last OR w.m - f.last >= 400 FROM f JOIN w ON w.trip = f.trip AND w.seq = f.seq + 1)
    SELECT trip, seq::INT AS seq, round(last, 2) AS total_m FROM f WHERE kept"""
)
def track_recording(spark: SparkSession, sf: str) -> DataFrame:
    """The samples that a recording keeps, one in 400 metres of way."""
    return tracks.recorded(g.track(spark, sf), 400.0).withColumn("total_m", F.round("total_m", 2))


@query(None)
def map_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Every sample, set off its way by some metres, matched to its trip's way, with the session so far; held to plain loops by the tests."""
    samples = g.track(spark, sf).select("trip", "seq", (F.col("lat_e7") + 1370).alias("lat_e7"), (F.col("lon_e7") - 2110).alias("lon_e7"), (F.col("speed_cms") / 100).alias("speed_mps"), "heading_deg", "dt_s")
    found = matching.matched(samples, g.routes(spark, sf))
    return found.select("trip", "seq", "segment", "status", "reroute", "reroutes", F.round("distance_m", 3).alias("distance_m"), F.round("remaining_m", 2).alias("remaining_m"), F.round("way_m", 2).alias("way_m"))


@query(
    """WITH p AS (SELECT l_orderkey AS route, l_linenumber % 2 AS leg, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey AS point, (l_partkey % 3)::DOUBLE AS lat, 0.0::DOUBLE AS lon, (l_suppkey % 8)::INT AS flags FROM lineitem),
    n AS (SELECT *, sum(CASE WHEN coalesce(abs(lat - pl) <= 1e-10, false) THEN 0 ELSE 1 END) OVER (PARTITION BY route ORDER BY leg, point ROWS UNBOUNDED PRECEDING)::BIGINT AS seq FROM (SELECT *, lag(lat) OVER (PARTITION BY route ORDER BY leg, point) AS pl FROM p))
    SELECT route, seq, any_value(lat) AS lat, any_value(lon) AS lon, bit_or(flags) AS flags FROM n GROUP BY 1, 2"""
)
def route_legs_joined(spark: SparkSession, sf: str) -> DataFrame:
    """Legs of routes in order, points that repeat the one before taken together."""
    line = F.col("l_linenumber")
    legs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route"), (line % 2).alias("leg"), (line.cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("point"), (F.col("l_partkey") % 3).cast("double").alias("lat"), F.lit(0.0).alias("lon"), (F.col("l_suppkey") % 8).cast("int").alias("flags"))
    return routing.legs_joined(legs)


@query(
    """WITH l AS (SELECT l_suppkey AS owner, l_orderkey * 10 + l_linenumber AS loop, (l_quantity * 4000)::DOUBLE AS length_m, (l_partkey % 500 * 40)::DOUBLE AS repeated_m, (l_extendedprice * 5000)::DOUBLE AS area_m2, (l_discount * 10)::DOUBLE AS waypoint FROM lineitem),
    s AS (SELECT *, 100 * (0.55 * greatest(0.0, least(1.0, 1 - abs(length_m - 100000) / 100000 / 0.40)) + 0.25 * greatest(0.0, least(1.0, 1 - repeated_m / length_m / 0.30)) + 0.10 * greatest(0.0, least(1.0, 4 * 3.141592653589793 * area_m2 / (length_m * length_m))) + 0.10 * greatest(0.0, least(1.0, waypoint))) AS score FROM l)
    SELECT owner, loop, round(score, 6) AS score, row_number() OVER (PARTITION BY owner ORDER BY round(score, 6) DESC, loop)::INT AS nth FROM s QUALIFY nth <= 3"""
)
def loop_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """The three best loops of each owner by score, earlier ones first among equals."""
    loops = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("owner"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("loop"), (F.col("l_quantity") * 4000).cast("double").alias("length_m"), (F.col("l_partkey") % 500 * 40).cast("double").alias("repeated_m"),
        (F.col("l_extendedprice") * 5000).cast("double").alias("area_m2"), (F.col("l_discount") * 10).cast("double").alias("waypoint"),
    )
    rows = routing.loop_scores(loops, F.lit(100_000.0)).withColumn("score", F.round("score", 6))
    nth = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("score"), "loop"))
    return rows.select("owner", "loop", "score", nth.alias("nth")).filter("nth <= 3")


# Rings and tiles ----------------------------------------------------------------------------------

_RINGS = """rings AS (SELECT l_orderkey AS ring_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, (l_partkey * 7 % 97)::DOUBLE AS x, (l_suppkey * 13 % 89 + l_linenumber)::DOUBLE AS y FROM lineitem),
sides AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM rings WINDOW w AS (PARTITION BY ring_id ORDER BY seq))"""


def _rings(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ring_id"), F.row_number().over(order).alias("seq"), (F.col("l_partkey") * 7 % 97).cast("double").alias("x"), (F.col("l_suppkey") * 13 % 89 + F.col("l_linenumber")).cast("double").alias("y"))


@query(f"WITH {_RINGS} SELECT ring_id, seq * 2 AS seq, x + (nx - x) * 0.25 AS x, y + (ny - y) * 0.25 AS y FROM sides UNION ALL SELECT ring_id, seq * 2 + 1, x + (nx - x) * 0.75, y + (ny - y) * 0.75 FROM sides")
def ring_corners_cut(spark: SparkSession, sf: str) -> DataFrame:
    """One pass of corner cutting over all rings."""
    return polygons.corners_cut(_rings(spark, sf))


@query(
    f"""WITH {_RINGS}, c AS (SELECT ring_id, seq, unnest(range(floor(least(y, ny) - 0.5)::BIGINT, floor(greatest(y, ny) + 0.5)::BIGINT + 1)) AS y0, x, y, nx, ny FROM sides WHERE y <> ny),
    k AS (SELECT ring_id, y0, seq, x + (y0 + 0.5 - y) * (nx - x) / (ny - y) AS cross_ FROM c WHERE (y <= y0 + 0.5) <> (ny <= y0 + 0.5)),
    p AS (SELECT *, row_number() OVER w AS nth, lead(cross_) OVER w AS until FROM k WINDOW w AS (PARTITION BY ring_id, y0 ORDER BY cross_, seq)), s AS (SELECT ring_id, y0 AS y, ceil(cross_ - 0.5)::BIGINT AS x_from, (ceil(until - 0.5) - 1)::BIGINT AS x_to FROM p WHERE nth % 2 = 1 AND until IS NOT NULL)
    SELECT * FROM s WHERE x_from <= x_to"""
)
def ring_raster(spark: SparkSession, sf: str) -> DataFrame:
    """The cells inside each ring, as runs."""
    return polygons.rastered(_rings(spark, sf))


@query(
    f"""WITH {o.CELLS}, i AS (SELECT x, y, x - row_number() OVER (PARTITION BY y ORDER BY x) AS island FROM cells), runs AS (SELECT y, min(x) AS x_from, max(x) AS x_to FROM i GROUP BY y, island),
    j AS (SELECT *, y - row_number() OVER (PARTITION BY x_from, x_to ORDER BY y) AS island FROM runs) SELECT x_from, x_to, min(y) AS y_from, max(y) AS y_to FROM j GROUP BY x_from, x_to, island"""
)
def mask_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    """The runs of the mask, equal ones of neighbouring rows as one rectangle."""
    k = F.col("o_orderkey")
    cells = table(spark, sf, "orders").select(((k * 7919 + k % 13) % 600).cast("int").alias("x"), ((k * 31 + k % 7) % 600).cast("int").alias("y")).distinct()
    return polygons.rectangles(tiles.runs(cells))


@query(
    f"""WITH {o.EDGES}, s AS (SELECT edge_id AS segment, a.lat_e7 // 10000000 AS y1, a.lon_e7 // 10000000 AS x1, b.lat_e7 // 10000000 AS y2, b.lon_e7 // 10000000 AS x2 FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst),
    n AS (SELECT *, greatest(abs(y2 - y1), abs(x2 - x1)) AS n FROM s), i AS (SELECT *, unnest(range(n + 1)) AS i FROM n)
    SELECT DISTINCT segment, CASE WHEN n = 0 THEN y1 ELSE y1 + floor((2 * i * (y2 - y1) + n) / (2 * n)::DOUBLE)::BIGINT END AS cell_y, CASE WHEN n = 0 THEN x1 ELSE x1 + floor((2 * i * (x2 - x1) + n) / (2 * n)::DOUBLE)::BIGINT END AS cell_x FROM i"""
)
def segment_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The grid cells that each edge runs through, by steps of its longer axis."""
    n = g.nodes(spark, sf)
    down = lambda c: F.expr(f"{c} DIV 10000000")
    ends = g.edges(spark, sf).select("edge_id", "src", "dst").join(n.toDF("src", "a_lat", "a_lon"), "src").join(n.toDF("dst", "b_lat", "b_lon"), "dst")
    return polygons.cells_of(ends.select(F.col("edge_id").alias("segment"), down("a_lat").alias("y1"), down("a_lon").alias("x1"), down("b_lat").alias("y2"), down("b_lon").alias("x2")))


@query(
    f"""WITH {o.LINES}, t AS (SELECT kind, floor(x1 * 64)::INT AS tile_x, floor(y1 * 64)::INT AS tile_y, line_id FROM lines), g AS (SELECT kind, tile_x, tile_y, list(line_id ORDER BY line_id) AS ids FROM t GROUP BY ALL),
    c AS (SELECT kind, tile_x, count(*) AS tiles, sum(len(ids)) AS records, md5(string_agg(tile_y || ':' || len(ids), ',' ORDER BY tile_y)) AS digest FROM g GROUP BY 1, 2)
    SELECT kind, sum(tiles)::BIGINT AS tiles, sum(records)::BIGINT AS records, md5(string_agg(tile_x || ':' || digest, ',' ORDER BY tile_x)) AS manifest FROM c GROUP BY 1"""
)
def tile_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Records gathered by tile, and for each kind the tiles, the records and a digest of all tiles in order."""
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    lines = table(spark, sf, "lineitem").select((k * 10 + F.col("l_linenumber")).alias("line_id"), (k % 3).cast("int").alias("kind"), (k * 7919 % 100000 / 100000.0).alias("x1"), (k * 104729 % 100000 / 100000.0).alias("y1"))
    at = lambda c: F.floor(F.col(c) * 64).cast("int")
    return tiles.manifest(tiles.bucketed(lines.select("kind", at("x1").alias("tile_x"), at("y1").alias("tile_y"), "line_id"), ["kind", "tile_x", "tile_y"], "line_id"), "kind")


# Stored tables ------------------------------------------------------------------------------------


@query("SELECT o_custkey AS owner, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5")
def history_retained(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's five newest orders, as a history that deletes older ones on each insertion keeps them."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), "o_orderkey", "o_orderdate")
    return store.retained(rows, "owner", "o_orderdate", "o_orderkey", 5)


@query(
    """WITH c AS (SELECT user_id, (event_id % 17)::INT AS place, CASE WHEN event_id % 3 = 0 THEN 'delete' ELSE 'insert' END AS op, event_id, ts, value FROM events)
    SELECT user_id, place, event_id, ts, value FROM c QUALIFY row_number() OVER (PARTITION BY user_id, place ORDER BY ts DESC, event_id DESC) = 1 AND op <> 'delete'"""
)
def favourites_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The favourites that a stream of insertions and deletions leaves."""
    e = F.col("event_id")
    changes = table(spark, sf, "events").select("user_id", (e % 17).cast("int").alias("place"), F.when(e % 3 == 0, "delete").otherwise("insert").alias("op"), "event_id", "ts", "value")
    return store.kept(changes, ["user_id", "place"], "op", ["ts", "event_id"])


@query("""WITH s AS (SELECT event_type AS key, arg_max(props, (ts, event_id)) AS v FROM events GROUP BY 1), a AS (SELECT n_name AS key, n_name AS d FROM nation UNION ALL SELECT DISTINCT event_type, 'none' FROM events) SELECT key, coalesce(v, d) AS value FROM a LEFT JOIN s USING (key)""")
def settings_looked_up(spark: SparkSession, sf: str) -> DataFrame:
    """Settings by name, with what to fall back on where there is none."""
    events = table(spark, sf, "events")
    settings = store.upserted(events, "event_type", "props", ["ts", "event_id"]).toDF("key", "value")
    asked = table(spark, sf, "nation").select(F.col("n_name").alias("key"), F.col("n_name").alias("fallback")).union(events.select("event_type", F.lit("none")).distinct())
    return store.looked_up(asked, settings, "key", "value", "fallback")
