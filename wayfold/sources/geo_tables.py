"""Road, place and GPS tables laid over the driver's tables.

The driver's data has no geography, so ids are projected to coordinates by integer
arithmetic, which every engine computes alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo
from wayfold.session import table


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, lat_e7, lon_e7)."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("node_id"),
        (F.lit(420000000) + (F.col("c_custkey") * 7919 % 90000) * 1000).cast("long").alias("lat_e7"),
        (F.lit(-45000000) + (F.col("c_custkey") * 104729 % 120000) * 1000).cast("long").alias("lon_e7"),
    )


def node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, src, dst, road_class, flags, max_speed_kph, length_cm); loops are left out."""
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    raw = (
        order.crossJoin(F.broadcast(node_count(spark, sf_dir)))  # one row on the right
        .select(
            F.col("o_orderkey").alias("edge_id"),
            F.col("o_custkey").alias("src"),
            ((F.col("o_custkey") * 31 + F.col("o_orderkey")) % F.col("n")).alias("dst"),
            (1 + F.col("o_orderkey") % 12).cast("int").alias("road_class"),
            (F.col("o_orderkey") % 16).cast("int").alias("flags"),
            ((F.col("o_orderkey") % 14) * 10).cast("int").alias("max_speed_kph"),
        )
        .filter("src <> dst")
    )
    n = nodes(spark, sf_dir)
    a, b = n.toDF("src", "src_lat", "src_lon"), n.toDF("dst", "dst_lat", "dst_lon")
    metres = geo.haversine_m(F.col("src_lat") / 1e7, F.col("src_lon") / 1e7, F.col("dst_lat") / 1e7, F.col("dst_lon") / 1e7)
    return raw.join(a, "src").join(b, "dst").select("edge_id", "src", "dst", "road_class", "flags", "max_speed_kph", F.round(metres * 100).cast("long").alias("length_cm"))


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trip, seq, lat_e7, lon_e7, dt_s, speed_cms, heading_deg, event_id, ts): an integer random walk per user."""
    in_order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trip"),
        F.row_number().over(in_order).alias("seq"),
        (F.lit(430000000) + F.sum((e * 7919 % 2001 - 1000) * 10).over(so_far)).alias("lat_e7"),
        (F.lit(10000000) + F.sum((e * 104729 % 2001 - 1000) * 10).over(so_far)).alias("lon_e7"),
        (1 + e % 5).cast("int").alias("dt_s"),
        (F.round(F.col("value") * 100).cast("long") % 4000).alias("speed_cms"),
        (e * 37 % 360).cast("int").alias("heading_deg"),
        "event_id",
        "ts",
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trip, point, lat_e7, lon_e7): the samples of a trip as points of a way."""
    return track(spark, sf_dir).select("trip", (F.col("seq") - 1).alias("point"), "lat_e7", "lon_e7")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place_id, name, kind, rank, lat_e7, lon_e7)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("place_id"),
        F.col("p_name").alias("name"),
        (1 + F.col("p_partkey") % 10).cast("int").alias("kind"),
        F.col("p_size").alias("rank"),
        (F.lit(420000000) + (F.col("p_partkey") * 6007 % 90000) * 1000).cast("long").alias("lat_e7"),
        (F.lit(-45000000) + (F.col("p_partkey") * 99991 % 120000) * 1000).cast("long").alias("lon_e7"),
    )
