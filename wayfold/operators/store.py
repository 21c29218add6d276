"""Small stored tables: newest-first lists, retention, keep-last upserts, label order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest(rows: DataFrame, at: str, key: str, k: int = 50) -> DataFrame:
    """The k newest rows, later keys first among equals."""
    return rows.orderBy(F.desc(at), F.desc(key)).limit(k)


def upserted(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value): the last value written for each key."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def retained(rows: DataFrame, owner: str, at: str, key: str, k: int = 50) -> DataFrame:
    """Each owner's k newest rows: what is left when every insertion deletes all older ones."""
    order = Window.partitionBy(owner).orderBy(F.desc(at), F.desc(key))
    return rows.withColumn("__nth", F.row_number().over(order)).filter(F.col("__nth") <= k).drop("__nth")


def kept(changes: DataFrame, key: list[str], op: str, order: list[str]) -> DataFrame:
    """The rows that insertions and deletions leave: of each key the last change, unless it deletes."""
    names = [c for c in changes.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("last"))
    return last.filter(F.col(f"last.{op}") != "delete").select(*key, *[F.col(f"last.{n}").alias(n) for n in names if n != op])


def looked_up(asked: DataFrame, settings: DataFrame, key: str, value: str, fallback: str) -> DataFrame:
    """(key, value): settings by key, or what is asked for to fall back on."""
    return asked.join(settings.select(key, value), key, "left").select(key, F.coalesce(value, fallback).alias(value))


def reference_labels(labels: DataFrame, per_group: str, k: int = 3) -> DataFrame:
    """For each group the first k labels: cities, then towns, then villages, by rank and id."""
    order = Window.partitionBy(per_group).orderBy("kind", F.desc("rank"), "place_id")
    return labels.filter(F.col("kind").between(1, 3)).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


def package_status(regions: DataFrame, files: DataFrame) -> DataFrame:
    """(region_no, region, has_map, has_routing, has_search, bytes, ready, installed): what of each region's package is there, from files (region_no, artefact, bytes)."""
    there = lambda kind: F.coalesce(F.bool_or(F.col("artefact") == kind), F.lit(False))
    found = files.groupBy("region_no").agg(there("map").alias("has_map"), there("routing").alias("has_routing"), there("search").alias("has_search"), there("source").alias("has_source"), F.sum("bytes").alias("bytes"))
    rows = regions.select("region_no", "region").join(found, "region_no", "left").fillna(False, ["has_map", "has_routing", "has_search", "has_source"]).fillna(0, ["bytes"])
    whole = F.col("has_map") & F.col("has_routing") & F.col("has_search")
    return rows.withColumns({"installed": whole, "ready": whole | F.col("has_source")}).drop("has_source")
