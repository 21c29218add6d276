"""GPX documents by Spark's XML reader and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geo

_POINT = "struct<_lat: double, _lon: double, ele: double, name: string>"
_SCHEMA = f"wpt array<{_POINT}>, rte array<struct<name: string, rtept: array<{_POINT}>>>, trk array<struct<name: string, trkseg: array<struct<trkpt: array<{_POINT}>>>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, part, segment, seq, lat, lon, ele, name): the points of GPX files, invalid coordinates left out."""
    docs = spark.read.format("xml").option("rowTag", "gpx").option("ignoreNamespace", "true").schema(_SCHEMA).load(path).withColumn("file", F.input_file_name())
    shape = lambda kind, part, segment, p, seq: [F.col("file"), F.lit(kind).alias("kind"), part.alias("part"), segment.alias("segment"), seq.alias("seq"), p["_lat"].alias("lat"), p["_lon"].alias("lon"), p["ele"].alias("ele"), p["name"].alias("name")]
    zero = F.lit(0)
    ways = docs.select("file", F.posexplode("wpt").alias("seq", "p")).select(*shape("wpt", zero, zero, F.col("p"), F.col("seq")))
    routes = docs.select("file", F.posexplode("rte").alias("part", "r")).select("file", "part", F.posexplode("r.rtept").alias("seq", "p")).select(*shape("rte", F.col("part"), zero, F.col("p"), F.col("seq")))
    tracks = docs.select("file", F.posexplode("trk").alias("part", "t")).select("file", "part", F.posexplode("t.trkseg").alias("segment", "s")).select("file", "part", "segment", F.posexplode("s.trkpt").alias("seq", "p")).select(*shape("trk", F.col("part"), F.col("segment"), F.col("p"), F.col("seq")))
    return ways.unionByName(routes).unionByName(tracks).filter(geo.valid(F.col("lat"), F.col("lon")))


def escaped(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def documents(points: DataFrame) -> DataFrame:
    """(trip, gpx): one document per trip of (trip, seq, lat, lon, name), its points in order."""
    point = F.format_string('<trkpt lat="%.8f" lon="%.8f"/>', "lat", "lon")
    rows = points.groupBy("trip").agg(F.sort_array(F.collect_list(F.struct("seq", point.alias("x")))).alias("pts"), F.first("name").alias("name"))
    body = F.array_join(F.transform("pts", lambda p: p["x"]), "")
    head = F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="wayfold" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>')
    return rows.select("trip", F.concat(head, escaped(F.coalesce("name", F.lit(""))), F.lit("</name><trkseg>"), body, F.lit("</trkseg></trk></gpx>")).alias("gpx"))
