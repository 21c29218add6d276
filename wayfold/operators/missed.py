"""Missed turns: real branches off a route ahead of a rider, to be ridden instead of it.

Each junction 80 to 2,500 m ahead offers the roads that the route doesn't take. A branch is followed
by the road that leads farthest from the route, until it is long and far enough off. All branches of
all routes are walked together, a road a round. A route's nodes and line are one row each, so
how far off a node is costs its route's length, and no pairs of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo
from wayfold.session import stored

# Metres of way after which a branch may end, that it must have, nodes at most, riding speed.
ENOUGH_M, LEAST_M, MOST_NODES, SPEED_MPS = 220.0, 120.0, 32, 60.0 / 3.6


def _off_m(lat: Column, lon: Column, line: Column) -> Column:
    """Metres from a point to the nearest part of a line (array of lat and lon), on the plane at the point."""
    per_lat = geo.EARTH_M * math.pi / 180
    per_lon = F.cos(F.radians(lat)) * per_lat

    def part(k: Column) -> Column:
        a, b = line[k - 1], line[k]
        ax, ay = (a["lon"] - lon) * per_lon, (a["lat"] - lat) * per_lat
        dx, dy = (b["lon"] - a["lon"]) * per_lon, (b["lat"] - a["lat"]) * per_lat
        square = dx * dx + dy * dy
        t = F.when(square > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / square))).otherwise(0.0)
        return F.hypot(ax + dx * t, ay + dy * t)

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(line) - 1), part))


def planned(steps: DataFrame, arcs: DataFrame, nodes: DataFrame, riders: DataFrame, least_ahead_m: float = 80.0, most_ahead_m: float = 2500.0, least_off_m: float = 80.0) -> DataFrame:
    """(route, pos, trigger_m, path, length_m, off_m, time_s): for each route the first branch ahead that leads far enough off.

    steps: (route, pos, node) of three nodes or more, arcs: (edge_id, src, dst, length_cm, ferry), nodes: (node, lat, lon), riders: (route, at_m).
    Branches of one junction are tried by (dst, edge_id); among equally far roads the same order decides. Branches never
    meet the route or themselves and take no ferry. Routes without a branch have no row.
    """
    order = Window.partitionBy("route").orderBy("pos")
    on = steps.join(nodes, "node").withColumns({"b_lat": F.lag("lat").over(order), "b_lon": F.lag("lon").over(order)})
    step = F.coalesce(geo.haversine_m(F.col("b_lat"), F.col("b_lon"), F.col("lat"), F.col("lon")), F.lit(0.0))
    on = stored(on.withColumn("at_m", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0))).select("route", "pos", "node", "lat", "lon", "at_m"))
    line = F.sort_array(F.collect_list(F.struct("pos", "lat", "lon", "node")))
    routes = stored(on.groupBy("route").agg(line.alias("line"), F.max("pos").alias("last")).filter(F.size("line") >= 3).select("route", "line", "last", F.transform("line", lambda p: p["node"]).alias("on_route")))
    at = nodes.select(F.col("node").alias("dst"), "lat", "lon")
    roads = stored(arcs.filter(~F.coalesce("ferry", F.lit(False))).select("edge_id", "src", "dst", "length_cm").join(at, "dst"))

    now = F.greatest(F.lit(0.0), F.coalesce("now_m", F.lit(0.0)))
    ahead = on.withColumns({"before": F.lag("node").over(order), "after": F.lead("node").over(order)}).join(riders.select("route", F.col("at_m").alias("now_m")), "route").filter(F.col("at_m").between(now + least_ahead_m, now + most_ahead_m) & F.col("before").isNotNull() & F.col("after").isNotNull())
    starts = ahead.select("route", "pos", F.col("at_m").alias("trigger_m"), F.col("node").alias("src"), "before", "after", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")).join(roads, "src").filter("dst <> before AND dst <> after").join(routes, "route").filter(~F.array_contains("on_route", F.col("dst")))
    off = _off_m(F.col("lat"), F.col("lon"), F.col("line"))
    walk = starts.select("route", "pos", "trigger_m", F.struct("dst", "edge_id").alias("first"), F.array("src", "dst").alias("path"), geo.haversine_m(F.col("s_lat"), F.col("s_lon"), F.col("lat"), F.col("lon")).alias("length_m"), off.alias("off_m"), "lat", "lon")
    names, over = walk.columns, None
    walk = stored(walk)
    going = f"NOT (length_m >= {ENOUGH_M} AND off_m >= {least_off_m}) AND size(path) < {MOST_NODES}"
    while not walk.isEmpty():
        ended = walk.filter(f"NOT ({going})")
        open_ = walk.filter(going).withColumn("src", F.element_at("path", -1)).withColumnsRenamed({"lat": "s_lat", "lon": "s_lon"})
        met = open_.join(roads, "src").filter(~F.array_contains("path", F.col("dst"))).join(routes, "route").filter(~F.array_contains("on_route", F.col("dst")))
        met = met.withColumn("away", off).withColumn("next", F.struct((-(F.col("away") + F.col("length_cm") / 100000.0)).alias("score"), "dst", "edge_id", "away", "lat", "lon"))
        chosen = met.groupBy("route", "pos", "first").agg(F.min("next").alias("next"))
        both = open_.join(chosen, ["route", "pos", "first"], "left")
        stuck = both.filter("next IS NULL").withColumnsRenamed({"s_lat": "lat", "s_lon": "lon"})
        done = ended.select(*names).unionByName(stuck.select(*names))
        over = stored(done if over is None else over.unionByName(done))
        more = geo.haversine_m(F.col("s_lat"), F.col("s_lon"), F.col("next.lat"), F.col("next.lon"))
        longer = both.filter("next IS NOT NULL").select("route", "pos", "trigger_m", "first", F.concat("path", F.array("next.dst")).alias("path"), (F.col("length_m") + more).alias("length_m"), F.greatest("off_m", "next.away").alias("off_m"), "next.lat", "next.lon")
        walk = stored(longer)
    good = (walk if over is None else over).filter((F.col("length_m") >= LEAST_M) & (F.col("off_m") >= least_off_m))
    best = good.groupBy("route").agg(F.min_by(F.struct("pos", "trigger_m", "path", "length_m", "off_m"), F.struct("pos", "first")).alias("b")).select("route", "b.*")
    return best.withColumn("time_s", F.col("length_m") / SPEED_MPS)
