"""Road graphs and map features from tagged ways and nodes, by relational algebra.

Ways are (id, tags map<string,string>, refs array<bigint>), nodes (id, lat_e7, lon_e7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo, roads, text
from wayfold.session import stored


def routable(ways: DataFrame) -> DataFrame:
    """The ways that a motor vehicle may use, with road_class, surface, flags, direction and max_speed_kph.

    A ferry is of class OTHER with its flag; a path needs an explicit permission.
    """
    t = F.col("tags")
    ferry = F.coalesce(t["route"] == "ferry", F.lit(False))
    kind = F.when(ferry, 12).otherwise(roads.class_of_highway(t["highway"]))
    surface = roads.surface_of(t["surface"])
    flags = F.when(F.coalesce(t["toll"].isin("yes", "true", "1"), F.lit(False)), roads.TOLL).otherwise(0) + F.when(ferry, roads.FERRY).otherwise(0) + F.when(roads.unpaved_surface(surface), roads.UNPAVED).otherwise(0)
    rows = ways.filter(F.size("refs") >= 2).withColumns({"road_class": kind, "surface": surface, "flags": flags, "direction": roads.direction(t), "max_speed_kph": roads.max_speed_kph(t["maxspeed"])})
    return rows.filter((F.col("road_class") > 0) & ~roads.access_denied(t) & ((F.col("road_class") != 11) | roads.motor_permitted(t)))


def edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, pos, src, dst, road_class, surface, flags, max_speed_kph, length_cm): the directed edges of routable ways.

    A pair of references whose node is missing, or that is one node, leaves a gap in its
    way. Two equi-joins on node ids; a way's own attributes ride along.
    """
    way = routable(ways).select("id", "refs", "road_class", "surface", "flags", "direction", "max_speed_kph")
    pairs = way.withColumn("pair", F.explode(F.expr("transform(sequence(0, size(refs) - 2), i -> named_struct('pos', i, 'a', refs[i], 'b', refs[i + 1]))"))).drop("refs").select("*", "pair.*").drop("pair").filter("a <> b")
    n = nodes.select("id", "lat_e7", "lon_e7")
    both = pairs.join(n.toDF("a", "a_lat", "a_lon"), "a").join(n.toDF("b", "b_lat", "b_lon"), "b")
    metres = geo.haversine_m(F.col("a_lat") / 1e7, F.col("a_lon") / 1e7, F.col("b_lat") / 1e7, F.col("b_lon") / 1e7)
    sides = F.array_compact(F.array(F.when(F.col("direction") != "backward", F.struct(F.col("a").alias("src"), F.col("b").alias("dst"))), F.when(F.col("direction") != "forward", F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))))
    return both.withColumn("length_cm", F.round(metres * 100).cast("long")).withColumn("e", F.explode(sides)).select(F.col("id").alias("way_id"), "pos", "e.src", "e.dst", "road_class", "surface", "flags", "max_speed_kph", "length_cm")


def counters(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: ways, routable ways, nodes that those reference, and how many of these are there."""
    refs = routable(ways).select(F.explode("refs").alias("id")).distinct()
    found = refs.join(nodes.select("id").withColumn("there", F.lit(1)), "id", "left").agg(F.count("*").alias("referenced"), F.count("there").alias("found"))
    return ways.agg(F.count("*").alias("ways")).crossJoin(routable(ways).agg(F.count("*").alias("routable"))).crossJoin(found)  # one row each


def places(nodes: DataFrame) -> DataFrame:
    """(id, name, normalized, kind, rank, lat_e7, lon_e7) of nodes (id, tags, lat_e7, lon_e7) that are named places; of a repeated id the last row (by version).

    The French name comes first; a place whose name has no letter or digit is left out.
    """
    kind, base = text.place_kind(F.col("tags"))
    name = F.coalesce(F.col("tags")["name:fr"], F.col("tags")["name"])
    rows = nodes.select("id", "version", name.alias("name"), kind.alias("kind"), text.place_rank(base, text.population(F.coalesce(F.col("tags")["population"], F.lit("")))).alias("rank"), "lat_e7", "lon_e7")
    named = rows.filter("kind IS NOT NULL AND name IS NOT NULL").withColumn("normalized", text.normalized(F.col("name"))).filter("normalized IS NOT NULL")
    columns = ["name", "normalized", "kind", "rank", "lat_e7", "lon_e7"]
    return named.groupBy("id").agg(F.max_by(F.struct(*columns), "version").alias("p")).select("id", "p.*")


def located(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, kind, points) of features (id, kind, refs): their nodes in order; one missing node drops the feature, and so do too few points.

    Lines need two points, areas four, a building that stands for itself one.
    """
    refs = features.select("id", "kind", F.size("refs").alias("n"), F.posexplode("refs").alias("pos", "ref"))
    found = refs.join(nodes.select(F.col("id").alias("ref"), "lat_e7", "lon_e7"), "ref").groupBy("id", "kind", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "lat_e7", "lon_e7"))).alias("points"))
    line = F.col("kind").isin("river", "canal", "stream", "drain", "coastline", "motorway", "trunk", "primary")
    enough = F.when(line, F.col("n") >= 2).otherwise((F.col("n") >= 4) | ((F.col("kind") == "building") & (F.col("n") == 1)))
    return found.filter((F.size("points") == F.col("n")) & enough).select("id", "kind", "points")


def stored_refs(kind: Column, tags: Column, refs: Column) -> Column:
    """The references that are kept of an area: a closed building outside built-up land is its first point."""
    alone = (kind == "building") & (F.element_at(refs, 1) == F.element_at(refs, -1)) & ~F.coalesce(tags["landuse"].isin("residential", "commercial", "industrial", "retail"), F.lit(False))
    return F.when(alone, F.slice(refs, 1, 1)).otherwise(refs)


def waterway_kind(tags: Column) -> Column:
    """'river', 'canal', 'stream' or 'drain' (ditches too); null for anything else."""
    return F.when(tags["waterway"].isin("river", "canal", "stream"), tags["waterway"]).when(tags["waterway"].isin("drain", "ditch"), "drain")


def overview_kind(tags: Column) -> Column:
    """'coastline', 'motorway', 'trunk' or 'primary'; null for anything else."""
    road = F.create_map(F.lit(1), F.lit("motorway"), F.lit(2), F.lit("trunk"), F.lit(3), F.lit("primary"))
    return F.when(tags["natural"] == "coastline", "coastline").otherwise(road[roads.class_of_highway(tags["highway"])])


def members(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """(relation, role, way, refs) of relations (id, members array<struct<type, ref, role>>): their member ways that are there."""
    rows = relations.select(F.col("id").alias("relation"), F.explode("members").alias("m")).filter("m.type = 'way'")
    return rows.select("relation", F.col("m.role").alias("role"), F.col("m.ref").alias("id")).join(ways.select("id", "refs"), "id").select("relation", "role", F.col("id").alias("way"), "refs")


def area_kind(tags: Column) -> Column:
    """'water', 'green', 'built_up' or 'building', in this order of precedence; null for anything else."""
    water = ((tags["natural"] == "water") & (F.coalesce(tags["water"], F.lit("")) != "no")) | tags["landuse"].isin("reservoir", "basin") | (tags["waterway"] == "riverbank")
    green = tags["natural"].isin("wood", "grassland", "scrub", "heath") | tags["landuse"].isin("forest", "grass", "meadow", "recreation_ground", "village_green") | tags["leisure"].isin("park", "garden", "nature_reserve")
    built = tags["landuse"].isin("residential", "commercial", "industrial", "retail")
    building = tags["building"].isNotNull() & ~tags["building"].isin("no", "0")
    no = F.lit(False)
    return F.when(F.coalesce(water, no), "water").when(F.coalesce(green, no), "green").when(F.coalesce(built, no), "built_up").when(F.coalesce(building, no), "building")


def ring_sides(rings: DataFrame) -> DataFrame:
    """(region, ring, hole, x1, y1, x2, y2) from the corners (region, ring, hole, seq, x, y); rings close by themselves."""
    order = Window.partitionBy("region", "ring").orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    return rings.select("region", "ring", "hole", F.col("x").alias("x1"), F.col("y").alias("y1"), ahead("x").alias("x2"), ahead("y").alias("y2"))


def ring_cells(sides: DataFrame, cell: float) -> DataFrame:
    """(region, ring, hole, row, col, border): the cells of a grid that rings touch (border), and those that lie inside as a whole."""
    key = ["region", "ring", "hole"]
    rows = sides.withColumn("row", F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))))
    # The stretch of a side beside a row of cells, a little more for rounding.
    rise = F.col("y2") - F.col("y1")
    share = lambda y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - F.col("y1")) / rise))
    t0, t1 = F.when(rise == 0, 0.0).otherwise(share(F.col("row") * cell)), F.when(rise == 0, 1.0).otherwise(share((F.col("row") + 1) * cell))
    x0, x1 = F.col("x1") + (F.col("x2") - F.col("x1")) * t0, F.col("x1") + (F.col("x2") - F.col("x1")) * t1
    columns = F.sequence(F.floor(F.least(x0, x1) / cell - 1e-6), F.floor(F.greatest(x0, x1) / cell + 1e-6))
    border = rows.select(*key, "row", F.explode(columns).alias("col")).distinct()
    # Along the middle of a row a ring's crossings, by turns, go in and out.
    middle = (F.col("row") + 0.5) * cell
    cross = rows.filter((F.col("y1") > middle) != (F.col("y2") > middle)).withColumn("x", F.col("x1") + (middle - F.col("y1")) * (F.col("x2") - F.col("x1")) / rise)
    order = Window.partitionBy(*key, "row").orderBy("x")
    paired = cross.withColumns({"nth": F.row_number().over(order), "until": F.lead("x").over(order)}).filter("nth % 2 = 1 AND until IS NOT NULL")
    low, high = F.ceil(F.col("x") / cell - 0.5), F.floor(F.col("until") / cell - 0.5)
    inside = paired.filter(low <= high).select(*key, "row", F.explode(F.sequence(low, high)).alias("col")).distinct()
    return border.withColumn("border", F.lit(True)).unionByName(inside.join(border, [*key, "row", "col"], "left_anti").withColumn("border", F.lit(False)))


def regions_of(points: DataFrame, rings: DataFrame, cell: float = 0.25) -> DataFrame:
    """(point_id, region): for each point (point_id, x, y) the first region whose rings hold it, holes excluded.

    A point meets the rings of its cell: those that hold the whole cell are settled by an equi-join on it. Only where a
    ring's border passes through the cell, the point meets that ring's sides of its row, and crossings are counted.
    """
    every = stored(ring_sides(rings))
    sides = every.filter("y1 <> y2").withColumn("row", F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))))
    asked = points.withColumns({"row": F.floor(F.col("y") / cell), "col": F.floor(F.col("x") / cell)})
    met = asked.join(ring_cells(every, cell), ["row", "col"])
    crossing = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    near = met.filter("border").join(sides, ["region", "ring", "hole", "row"]).filter(crossing).groupBy("point_id", "region", "ring", "hole").agg(F.count("*").alias("n")).filter("n % 2 = 1")
    inside = near.drop("n").unionByName(met.filter("NOT border").select("point_id", "region", "ring", "hole"))
    kept = inside.groupBy("point_id", "region").agg(F.bool_or("hole").alias("in_hole")).filter("NOT in_hole")
    return kept.groupBy("point_id").agg(F.min("region").alias("region"))


def read_poly(spark, path: str) -> DataFrame:
    """(region, ring, hole, seq, x, y) from boundary files: a name, rings of 'lon lat' lines that end in END, a hole's name begins with '!'."""
    lines = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    parts = lines.select(F.posexplode(F.expr("filter(transform(split(value, '\\n'), l -> trim(l)), l -> l <> '')")).alias("no", "line"), "file", F.trim(F.split("value", "\n")[0]).alias("region"))
    order = Window.partitionBy("file").orderBy("no")
    ends = F.coalesce(F.sum((F.col("line") == "END").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = parts.filter("no > 0").withColumn("ring", ends)
    ring = Window.partitionBy("file", "ring").orderBy("no")
    named = numbered.withColumns({"nth": F.row_number().over(ring), "name": F.first("line").over(ring)}).filter("nth > 1 AND line <> 'END'")
    xy = F.split("line", r"\s+")
    return named.select("region", "ring", F.col("name").startswith("!").alias("hole"), (F.col("nth") - 2).alias("seq"), xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))
