"""Map tiles and masks as tables of cells: morphology, pyramids, clipping, generalisation, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo
from wayfold.operators import spatial
from wayfold.session import stored


def _around(cells: DataFrame) -> DataFrame:
    """Each cell nine times, once for each cell of its 3 x 3 square."""
    offsets = F.sequence(F.lit(-1), F.lit(1))
    return cells.withColumn("dy", F.explode(offsets)).withColumn("dx", F.explode(offsets)).select((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))


def dilated(cells: DataFrame) -> DataFrame:
    return _around(cells).distinct()


def eroded(cells: DataFrame) -> DataFrame:
    """Cells whose whole 3 x 3 square is set."""
    return _around(cells).groupBy("x", "y").agg(F.count("*").alias("n")).filter("n = 9").select("x", "y")


def closed(cells: DataFrame) -> DataFrame:
    """Morphological closing: dilation, then erosion."""
    return eroded(dilated(cells.select("x", "y").distinct()))


def dense(cells: DataFrame, least: int = 3) -> DataFrame:
    """Cells with at least so many set cells in their 3 x 3 square, themselves counted."""
    one = cells.select("x", "y").distinct()
    counts = _around(one).groupBy("x", "y").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return one.join(counts, ["x", "y"])


def parents(cells: DataFrame, levels: int = 1) -> DataFrame:
    """Cells of the coarser level: set where any of the finer ones is."""
    return cells.select(F.shiftright("x", levels).alias("x"), F.shiftright("y", levels).alias("y")).distinct()


def boundary(cells: DataFrame) -> DataFrame:
    """(x, y, side): sides of set cells that face an unset one."""
    one = cells.select("x", "y").distinct()
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for s, dx, dy in (("N", 0, -1), ("E", 1, 0), ("S", 0, 1), ("W", -1, 0))]))
    faces = one.withColumn("f", sides).select("x", "y", "f.side", (F.col("x") + F.col("f.dx")).alias("nx"), (F.col("y") + F.col("f.dy")).alias("ny"))
    return faces.join(one.toDF("nx", "ny"), ["nx", "ny"], "left_anti").select("x", "y", "side")


def runs(cells: DataFrame) -> DataFrame:
    """(y, x_from, x_to): the maximal runs of set cells of each row."""
    one = cells.select("x", "y").distinct()
    island = F.col("x") - F.row_number().over(Window.partitionBy("y").orderBy("x"))
    return one.withColumn("island", island).groupBy("y", "island").agg(F.min("x").alias("x_from"), F.max("x").alias("x_to")).drop("island")


def clipped_lines(lines: DataFrame, zoom: int, most_tiles: int = 8) -> DataFrame:
    """(line_id, tile_x, tile_y, t0, t1): the part of each line (x1, y1, x2, y2 in the unit square) in each tile it crosses.

    Liang and Barsky's parameters as expressions. Lines that span more than `most_tiles`
    tiles either way are malformed and dropped.
    """
    n = float(1 << zoom)
    at = lambda c: F.col(c) * n
    low = lambda a, b: F.floor(F.least(at(a), at(b))).cast("int")
    high = lambda a, b: F.floor(F.greatest(at(a), at(b))).cast("int")
    fine = lines.filter((high("x1", "x2") - low("x1", "x2") <= most_tiles) & (high("y1", "y2") - low("y1", "y2") <= most_tiles))
    cells = fine.withColumn("tile_x", F.explode(F.sequence(low("x1", "x2"), high("x1", "x2")))).withColumn("tile_y", F.explode(F.sequence(low("y1", "y2"), high("y1", "y2"))))
    t0, t1 = F.lit(0.0), F.lit(1.0)
    fits = F.lit(True)
    for c, d, tile in (("x1", "x2", "tile_x"), ("y1", "y2", "tile_y")):
        start, delta = at(c), at(d) - at(c)
        enter, leave = (F.col(tile) - start) / delta, (F.col(tile) + 1 - start) / delta
        t0 = F.greatest(t0, F.when(delta == 0, 0.0).otherwise(F.least(enter, leave)))
        t1 = F.least(t1, F.when(delta == 0, 1.0).otherwise(F.greatest(enter, leave)))
        fits = fits & ((delta != 0) | ((start >= F.col(tile)) & (start <= F.col(tile) + 1)))
    return cells.withColumns({"t0": t0, "t1": t1}).filter(fits & (F.col("t0") < F.col("t1"))).select("line_id", "tile_x", "tile_y", "t0", "t1")


def generalized(lines: DataFrame, grid: int = 131072) -> DataFrame:
    """Lines on a coarse grid: quantised, ends in one order, without points and repetitions."""
    q = {c: F.round(F.col(c) * grid).cast("int") for c in ("x1", "y1", "x2", "y2")}
    rows = lines.select("kind", *[v.alias(c) for c, v in q.items()]).filter("x1 <> x2 OR y1 <> y2")
    turn = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    ends = [F.when(turn, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("x2", "x1"), ("y2", "y1"), ("x1", "x2"), ("y1", "y2"))]
    return rows.select("kind", *ends).distinct()


def tile_counts(points: DataFrame, zooms: list[int]) -> DataFrame:
    """(zoom, tiles, points): how many tiles of each zoom hold a point."""
    rows = points.withColumn("zoom", F.explode(F.array(*map(F.lit, zooms))))
    x, y = geo.tile(geo.mercator_x(F.col("lon_e7") / 1e7), F.col("zoom")), geo.tile(geo.mercator_y(F.col("lat_e7") / 1e7), F.col("zoom"))
    per_tile = rows.groupBy("zoom", x.alias("tile_x"), y.alias("tile_y")).agg(F.count("*").alias("n"))
    return per_tile.groupBy("zoom").agg(F.count("*").alias("tiles"), F.sum("n").alias("points"))


def robust_bounds(points: DataFrame, bin_e7: int = 500_000, trim: float = 0.0001, margin_e7: int = 1_000_000) -> DataFrame:
    """(axis, low_e7, high_e7): bounds without the outermost `trim` of the points, a margin added, never beyond the true ones."""
    axes = points.select(F.explode(F.array(F.struct(F.lit("lat").alias("axis"), F.col("lat_e7").alias("v")), F.struct(F.lit("lon").alias("axis"), F.col("lon_e7").alias("v")))).alias("p")).select("p.*")
    bins = axes.groupBy("axis", F.floor(F.col("v") / bin_e7).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    order = Window.partitionBy("axis").orderBy("bin")
    every = Window.partitionBy("axis")
    summed = bins.withColumns({"upto": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(every), "lo": F.min("lo").over(every), "hi": F.max("hi").over(every)})
    kept = summed.filter((F.col("upto") > trim * F.col("total")) & (F.col("upto") - F.col("n") < (1 - trim) * F.col("total")))
    low, high = F.min("bin") * bin_e7 - margin_e7, (F.max("bin") + 1) * bin_e7 + margin_e7
    return kept.groupBy("axis").agg(F.greatest(F.first("lo"), low).cast("long").alias("low_e7"), F.least(F.first("hi"), high).cast("long").alias("high_e7"))


def ring_areas(rings: DataFrame) -> DataFrame:
    """(ring_id, area2, perimeter2): twice the signed area by the shoelace rule over (ring_id, seq, x, y), and the summed squared sides."""
    order = Window.partitionBy("ring_id").orderBy("seq")
    whole = Window.partitionBy("ring_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(order), F.first(c).over(whole)) for c in ("x", "y"))
    sides = rings.withColumns({"nx": nx, "ny": ny})
    return sides.groupBy("ring_id").agg(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")).alias("area2"), F.sum(F.pow(F.col("nx") - F.col("x"), 2) + F.pow(F.col("ny") - F.col("y"), 2)).cast("long").alias("perimeter2"))


def bucketed(records: DataFrame, tile: list[str], record: str) -> DataFrame:
    """One row per tile with its records in order; a tile holds what lies in it, so its size is the map's density, not the table's."""
    return records.groupBy(*tile).agg(F.sort_array(F.collect_list(record)).alias("records"))


def manifest(tiles: DataFrame, layer: str) -> DataFrame:
    """(layer, tiles, records, manifest): per layer the number of tiles and records, and a digest of all tiles in order.

    First a digest of each column of tiles, then one of the columns' digests: no group is larger than the map is wide.
    """
    listed = lambda entries, parts: F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*entries))), lambda t: F.concat_ws(":", *[t[p] for p in parts])), ",").cast("binary"))
    sized = tiles.select(layer, "tile_x", "tile_y", F.size("records").alias("n"))
    columns = sized.groupBy(layer, "tile_x").agg(F.count("*").alias("tiles"), F.sum("n").alias("records"), listed(("tile_y", "n"), ("tile_y", "n")).alias("digest"))
    return columns.groupBy(layer).agg(F.sum("tiles").alias("tiles"), F.sum("records").alias("records"), listed(("tile_x", "digest"), ("tile_x", "digest")).alias("manifest"))


def levels(cells: DataFrame, steps: tuple[tuple[int, int, int], ...] = ((11, 5, 1), (10, 1, 1), (9, 1, 2))) -> DataFrame:
    """(level, x, y): coarser levels of a mask, each from the one before: (level, halvings, closing passes)."""
    out, now = None, cells
    for level, halvings, passes in steps:
        now = parents(now, halvings)
        for _ in range(passes):
            now = closed(now)
        now = stored(now)
        rows = now.select(F.lit(level).alias("level"), "x", "y")
        out = rows if out is None else out.unionByName(rows)
    return out


def retiled(lines: DataFrame, zooms: tuple[int, ...], most_tiles: int = 8) -> DataFrame:
    """(zoom, line_id, tile_x, tile_y, t0, t1): the lines' parts in the tiles of several zooms, one after the other."""
    parts = [clipped_lines(lines, z, most_tiles).select(F.lit(z).alias("zoom"), "line_id", "tile_x", "tile_y", "t0", "t1") for z in zooms]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


#: The least area in pixels that is kept at each zoom; water keeps half as much.
LEAST_PIXELS = {9: 5.0, 10: 3.0, 11: 1.5, 12: 0.8, 13: 0.4, 14: 0.2}


def large_enough(areas: DataFrame) -> DataFrame:
    """(zoom, ring_id, pixels) of rings (ring_id, world_area, water) for each zoom at which they are not too small."""
    zoom = F.explode(F.create_map(*[F.lit(x) for pair in LEAST_PIXELS.items() for x in pair])).alias("zoom", "least")
    pixels = F.abs(F.col("world_area")) * F.pow(F.lit(4.0), F.col("zoom")) * 65536
    rows = areas.select("ring_id", "world_area", "water", zoom).withColumn("pixels", pixels)
    return rows.filter(F.col("pixels") >= F.col("least") * F.when(F.col("water"), 0.5).otherwise(1.0)).select("zoom", "ring_id", "pixels")


def class_offsets(records: DataFrame) -> DataFrame:
    """(tile_x, tile_y, road_class, first, n): where the records of each class begin in a tile whose records are sorted by class."""
    counts = records.groupBy("tile_x", "tile_y", "road_class").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tile_x", "tile_y").orderBy("road_class").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def chunked(lines: DataFrame, layer: str, order: Column, part: Column, size: int = 256) -> DataFrame:
    """(layer, chunk, n, low_x, low_y, high_x, high_y): runs of so many lines of a layer, in order, with the box around each; `part` cuts the order into ranges, as in `spatial.numbered`."""
    rows = spatial.numbered(lines, layer, F.lit(0), order, part).withColumn("chunk", F.floor((F.col("nth") - 1) / size))
    box = [F.min(F.least("x1", "x2")).alias("low_x"), F.min(F.least("y1", "y2")).alias("low_y"), F.max(F.greatest("x1", "x2")).alias("high_x"), F.max(F.greatest("y1", "y2")).alias("high_y")]
    return rows.groupBy(layer, "chunk").agg(F.count("*").alias("n"), *box)


#: What becomes of a map feature: the layer, and for areas the pixels of tolerance and of least area.
DISPATCH = (("water", "area", 1.25, 4.0), ("water", "area", 0.35, 0.20), ("built_up", "mask", None, None), ("building", "mask", None, None), ("green", "mask", None, None),
            ("river", "line", None, None), ("canal", "line", None, None), ("stream", "line", None, None), ("drain", "line", None, None))


def dispatched(features: DataFrame) -> DataFrame:
    """The features (kind) once for each layer that they go to; kinds of no layer go."""
    rules = features.sparkSession.createDataFrame(list(DISPATCH), "kind string, layer string, tolerance_px double, least_px double")
    return features.join(F.broadcast(rules), "kind")  # nine rows
