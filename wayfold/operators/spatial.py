"""Spatial lookups on grids: cells, distinct segments, nearest node, nearest segment, gateways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo, roads
from wayfold.session import stored

CELL_E7 = 100_000  # 0.01 degree
MAP_E7 = 3_600_000_000
LEAST_E7 = 1_000  # some 11 m


def cell(e7: Column, size: int = CELL_E7) -> Column:
    return F.floor(e7 / size).cast("long")


def cell_counts(nodes: DataFrame, size: int = CELL_E7) -> DataFrame:
    """(cell_y, cell_x, n, first): nodes per cell, and how many lie in the cells before it, row by row.

    Rows of cells are windows of their own; what lies in whole rows before is a running sum over one number per row.
    """
    counts = nodes.groupBy(cell(F.col("lat_e7"), size).alias("cell_y"), cell(F.col("lon_e7"), size).alias("cell_x")).agg(F.count("*").alias("n"))
    return _with_first(counts, "cell_y", "cell_x")


def _with_first(counts: DataFrame, row: str, place: str) -> DataFrame:
    """counts (row, place, n) with `first`: the sum of n over all rows and places before."""
    rows = counts.groupBy(row).agg(F.sum("n").alias("row_n"))
    above = rows.select(row, F.coalesce(F.sum("row_n").over(Window.orderBy(row).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    before = Window.partitionBy(row).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("__inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return inside.join(above, row).withColumn("first", F.col("above") + F.col("__inside")).drop("above", "__inside")


def first_edges(edges: DataFrame, per_row: int = 4096) -> DataFrame:
    """(node, n, first): how many edges leave each node, and at which place its edges begin when all are sorted by (src, dst)."""
    counts = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).withColumn("__row", F.floor(F.col("node") / per_row))
    return _with_first(counts, "__row", "node").drop("__row")


def numbered(rows: DataFrame, group: str, rank: Column, order: Column, part: Column) -> DataFrame:
    """The rows with `nth`, their place from 1 within the group by falling rank, then by order.

    `part` rises with order and cuts it into ranges: places are counted inside a range of one rank, and added to what
    the ranges before hold, so a group of any size is dealt out. Ranks are few.
    """
    keyed = rows.withColumns({"__rank": rank, "__part": part})
    counts = keyed.groupBy(group, "__rank", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy(F.desc("__rank"), "__part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy(group, "__rank", "__part").orderBy(order))
    return keyed.withColumn("__nth", within).join(first, [group, "__rank", "__part"]).withColumn("nth", F.col("__first") + F.col("__nth")).drop("__rank", "__part", "__nth", "__first")


def sorted_edges(edges: DataFrame) -> DataFrame:
    """(place, src, dst, edge_id): all edges in the order of (src, dst, edge_id), places from 0."""
    within = Window.partitionBy("src").orderBy("dst", "edge_id")
    nth = edges.select("src", "dst", "edge_id").withColumn("__nth", F.row_number().over(within) - 1)
    return nth.join(first_edges(edges).select(F.col("node").alias("src"), "first"), "src").select((F.col("first") + F.col("__nth")).alias("place"), "src", "dst", "edge_id")


def segments(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b: each pair of joined nodes once."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()


def _either_side(lon: Column, reach: Column) -> Column:
    """A longitude, and within reach of 180 degrees the same seen from the other side."""
    half, turn = F.lit(MAP_E7 // 2), F.lit(MAP_E7)
    return F.array_compact(F.array(lon.cast("long"), F.when(lon > half - reach, lon - turn).cast("long"), F.when(lon < reach - half, lon + turn).cast("long")))


def nearest_node(points: DataFrame, nodes: DataFrame, size: int = CELL_E7) -> DataFrame:
    """(point_id, node_id, distance_m): the nearest node of each point; ties to the smaller node.

    Points meet the nodes of the cells around them. A point is done when no node outside
    the searched square can be nearer; the others search eight times as far, until cells as
    wide as the map leave no node outside. Each round is one equi-join on cells, over the
    points that are left. Nodes near 180 degrees are there twice, on either side of it.
    The first cells are at most of the given size, and so small that evenly spread nodes would have one each: what a point
    meets doesn't grow with the number of nodes.
    """
    box = nodes.agg(F.count("*").alias("n"), *((F.max(c) - F.min(c)).cast("double").alias(c) for c in ("lat_e7", "lon_e7"))).collect()[0]
    if box.n:
        size = max(1, min(size, max(LEAST_E7, int(max(box.lat_e7 * box.lon_e7 / box.n, (max(box.lat_e7, box.lon_e7) / box.n) ** 2) ** 0.5))))
    held = nodes.select("node_id", F.col("lat_e7").alias("n_lat"), F.col("lon_e7").alias("n_lon"), cell(F.col("lat_e7"), size).alias("cy"), cell(F.col("lon_e7"), size).alias("cx"))
    open_ = stored(points.select("point_id", "lat_e7", "lon_e7"))
    found, side = [], size
    while True:
        at = held.withColumn("x", F.explode(_either_side(F.col("n_lon"), F.lit(2 * side)))).withColumn("cy", F.floor(F.col("n_lat") / side)).withColumn("cx", F.floor(F.col("x") / side)).drop("x")
        around = F.sequence(F.lit(-1), F.lit(1))
        asked = open_.withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around)).withColumn("cy", F.floor(F.col("lat_e7") / side) + F.col("dy")).withColumn("cx", F.floor(F.col("lon_e7") / side) + F.col("dx"))
        # Where many points lie in few cells these have few nodes: small as they are, they go to the points, wherever those are.
        at = stored(at.join(asked.select("cy", "cx").distinct(), ["cy", "cx"], "left_semi"))
        metres = geo.haversine_m(F.col("lat_e7") / 1e7, F.col("lon_e7") / 1e7, F.col("n_lat") / 1e7, F.col("n_lon") / 1e7)
        best = asked.join(at, ["cy", "cx"]).groupBy("point_id", "lat_e7", "lon_e7").agg(F.min(F.struct(metres.alias("d"), "node_id")).alias("b"))
        # A node outside the 3 x 3 square is at least one cell away, in latitude or in longitude at the square's outer parallel.
        k = F.cos(F.radians(F.least(F.lit(90.0), F.abs(F.col("lat_e7") / 1e7) + 2 * side / 1e7)))
        safe = F.lit(geo.EARTH_M * 3.141592653589793 / 180 * side / 1e7) * k * F.lit(0.999)
        done = best.filter((F.col("b.d") <= safe) | F.lit(side >= MAP_E7)).select("point_id", F.col("b.node_id").alias("node_id"), F.col("b.d").alias("distance_m"))
        done = stored(done)
        found.append(done)
        open_ = stored(open_.join(done.select("point_id"), "point_id", "left_anti"))
        if side >= MAP_E7 or open_.isEmpty():
            break
        side *= 8
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


METRES_E7 = geo.EARTH_M * 3.141592653589793 / 180 / 1e7


def _planar2(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column, k: Column) -> Column:
    """Squared distance of a point from a segment on a plane whose longitudes shrink by k, in squared units of the coordinates."""
    dx, dy, px, py = (b_lon - a_lon) * k, b_lat - a_lat, (lon - a_lon) * k, lat - a_lat
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-9))))
    return (px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)


def _pairs_within(points: DataFrame, located: DataFrame, radius_m: float) -> DataFrame:
    """(point_id, d2, both ends): the segments whose planar distance from a point is within the radius, up to a thousandth more.

    A segment is entered in the cells that it comes near to, row by row, a cell being twice the radius wide, so
    each candidate is met once by an equi-join on the point's own cell, and compared by a few
    products. Spark splits a cell that holds very many points or segments as a skewed join key.
    """
    reach = int(radius_m / 111_000 * 1e7) + 1
    size = max(2 * reach, 500)
    wide = (reach / F.cos(F.radians(F.greatest(F.abs(F.col("a_lat")), F.abs(F.col("b_lat"))) / 1e7))).cast("long") + 1
    ends = [F.col(c).cast("double") for c in ("a_lat", "a_lon", "b_lat", "b_lon")]
    rows = located.withColumn("cy", F.explode(F.sequence(cell(F.least("a_lat", "b_lat") - reach, size), cell(F.greatest("a_lat", "b_lat") + reach, size))))
    # The stretch of the segment beside a row of cells, as shares of its length, and the cells that it passes there.
    rise, run = F.col("b_lat") - F.col("a_lat"), F.col("b_lon") - F.col("a_lon")
    low, high = (F.col("cy") * size - reach - F.col("a_lat")) / rise, (F.col("cy") * size + size + reach - F.col("a_lat")) / rise
    clamp = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    rows = rows.withColumns({"t0": F.when(rise == 0, 0.0).otherwise(clamp(F.least(low, high))), "t1": F.when(rise == 0, 1.0).otherwise(clamp(F.greatest(low, high)))})
    x0, x1 = F.col("a_lon") + F.col("t0") * run, F.col("a_lon") + F.col("t1") * run
    touched = rows.withColumn("cx", F.explode(F.sequence(cell(F.least(x0, x1) - wide, size), cell(F.greatest(x0, x1) + wide, size)))).drop("t0", "t1")
    k = F.greatest(F.cos(F.radians(F.col("lat_e7") / 1e7)), F.lit(1e-6))
    seen = points.select("point_id", "lat_e7", F.explode(_either_side(F.col("lon_e7"), (reach / k).cast("long") + 1)).alias("lon_e7"))  # from either side of 180 degrees
    asked = seen.select("point_id", "lat_e7", "lon_e7", F.cos(F.radians(F.col("lat_e7") / 1e7)).alias("k"), cell(F.col("lat_e7"), size).alias("cy"), cell(F.col("lon_e7"), size).alias("cx"))
    d2 = _planar2(F.col("lat_e7").cast("double"), F.col("lon_e7").cast("double"), *ends, F.col("k")) * METRES_E7**2
    return asked.join(touched, ["cy", "cx"]).withColumn("d2", d2).filter(F.col("d2") <= (radius_m * 1.001) ** 2).drop("cy", "cx", "k")


def snap(points: DataFrame, located: DataFrame, radius_m: float) -> DataFrame:
    """(point_id, a, b, fraction, distance_m): each point's nearest segment within the radius; ties to the smaller (a, b).

    `located` has a, b and both ends' coordinates. A 64th of the radius is searched first, an eighth and
    the whole radius then for the points that found nothing, so that dense places don't cost more. The least planar distance is a plain
    minimum; only segments as near as that, up to a thousandth, are measured on the globe.
    """
    open_, found = points.select("point_id", "lat_e7", "lon_e7"), []
    for radius in (radius_m / 64, radius_m / 8, radius_m):
        near = stored(_pairs_within(open_, located, radius))
        least = near.groupBy("point_id").agg(F.min("d2").alias("least"))
        close = near.join(least, "point_id").filter(F.col("d2") <= F.col("least") * 1.001 + 1e-6)
        p = [F.col(c) / 1e7 for c in ("lat_e7", "lon_e7", "a_lat", "a_lon", "b_lat", "b_lon")]
        f = F.col("fraction")
        close = close.withColumn("fraction", geo.projection_fraction(*p)).withColumn("distance_m", geo.haversine_m(p[0], p[1], p[2] + (p[4] - p[2]) * f, p[3] + (p[5] - p[3]) * f))
        best = close.groupBy("point_id").agg(F.min(F.struct("distance_m", "a", "b", "fraction")).alias("s")).select("point_id", "s.a", "s.b", "s.fraction", "s.distance_m")
        if radius == radius_m:
            found.append(best.filter(F.col("distance_m") <= radius_m))
        else:
            found.append(stored(best.filter(F.col("distance_m") <= radius * 0.999)))
            open_ = stored(open_.join(found[-1].select("point_id"), "point_id", "left_anti"))
    return found[0].unionByName(found[1]).unionByName(found[2])


def gateways(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_node, right_node, lat_e7, lon_e7, penalty_m): nodes of two graphs at the same place.

    Inputs: node_id, lat_e7, lon_e7, best_class of nodes that have an edge. Where a side
    repeats a place its smallest node counts.
    """
    one = lambda g, name: g.groupBy("lat_e7", "lon_e7").agg(F.min(F.struct("node_id", "best_class")).alias(name))
    both = one(left, "l").join(one(right, "r"), ["lat_e7", "lon_e7"])
    penalty = F.least(F.lit(65535), roads.gateway_penalty_m(F.col("l.best_class")) + roads.gateway_penalty_m(F.col("r.best_class")))
    return both.select(F.col("l.node_id").alias("left_node"), F.col("r.node_id").alias("right_node"), "lat_e7", "lon_e7", penalty.alias("penalty_m"))


def best_classes(edges: DataFrame) -> DataFrame:
    """(node_id, best_class): the lowest class number above 0 of a node's outgoing edges, 12 without one."""
    return edges.groupBy(F.col("src").alias("node_id")).agg(F.coalesce(F.min(F.when(F.col("road_class") > 0, F.col("road_class"))), F.lit(12)).alias("best_class"))


def top_gateways(found: DataFrame, start: tuple[float, float], goal: tuple[float, float], k: int = 8) -> DataFrame:
    """The k gateways of least detour: metres from the start and to the goal, plus the penalty; ties to the smaller nodes."""
    lat, lon = F.col("lat_e7") / 1e7, F.col("lon_e7") / 1e7
    metres = geo.haversine_m(F.lit(start[0]), F.lit(start[1]), lat, lon) + geo.haversine_m(lat, lon, F.lit(goal[0]), F.lit(goal[1]))
    return found.withColumn("score", metres + F.col("penalty_m")).orderBy("score", "left_node", "right_node").limit(k)


def within(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """The points inside the extent of the nodes, which is one row."""
    box = nodes.agg(F.min("lat_e7").alias("__s"), F.max("lat_e7").alias("__n"), F.min("lon_e7").alias("__w"), F.max("lon_e7").alias("__e"))
    inside = F.col("lat_e7").between(F.col("__s"), F.col("__n")) & F.col("lon_e7").between(F.col("__w"), F.col("__e"))
    return points.crossJoin(F.broadcast(box)).filter(inside).drop("__s", "__n", "__w", "__e")
