"""Ranked place search: normalised names, match classes, merging of several sources."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import text
from wayfold.operators import packages
from wayfold.session import stored


def _hits(places: DataFrame, query: str, least_chars: int) -> DataFrame:
    """The places that a query finds, with `normalized` and `match`."""
    asked = places.sparkSession.range(1).select(text.normalized(F.lit(query)).alias("q")).collect()[0].q or ""
    named = places.withColumn("normalized", text.normalized(F.col("name")))
    return named.withColumn("match", text.match_class(F.col("normalized"), asked)).filter(F.col("match").isNotNull() if len(asked) >= least_chars else F.lit(False))


def search(places: DataFrame, query: str, limit: int = 8, least_chars: int = 2) -> DataFrame:
    """The best places for a query, with `match`: exact, then prefix, then contained; higher rank, shorter name, name, id.

    `query` is compared in normalised form; shorter ones than `least_chars` find nothing.
    """
    return _hits(places, query, least_chars).orderBy("match", F.desc("rank"), F.length("name"), text.lower_ascii(F.col("name")), "place_id").limit(limit)


def merged(sources: list[DataFrame], query: str, limit: int = 8) -> DataFrame:
    """The best of several sources; a place found again at the same spot under the same name counts once, the earlier source's.

    Copies go before the only cut, so a source's copies take no room from its other places.
    """
    found = [_hits(s, query, 2).withColumn("source_no", F.lit(k)) for k, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, found)
    first = F.min_by(F.struct(*rows.columns), F.struct("source_no", "place_id")).alias("first")
    once = rows.groupBy(F.col("lat_e7").alias("y"), F.col("lon_e7").alias("x"), F.col("normalized").alias("n")).agg(first).select("first.*")
    return once.orderBy("match", F.desc("rank"), F.length("normalized"), "name", "place_id").limit(limit)


def by_pairs(places: DataFrame, asked: DataFrame, limit: int = 8) -> DataFrame:
    """The best places for each of many texts (asked) of two letters in normalised form: an equi-join with the pairs of letters of the names."""
    named = places.withColumn("normalized", text.normalized(F.col("name"))).filter(F.length("normalized") >= 2)
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("normalized") - 1), lambda k: F.substring("normalized", k, F.lit(2))))
    hits = named.withColumn("asked", F.explode(pairs)).join(asked, "asked")
    match = F.when(F.col("normalized") == F.col("asked"), 0).when(F.startswith("normalized", F.col("asked")), 1).otherwise(2)
    order = Window.partitionBy("asked").orderBy("match", F.desc("rank"), F.length("name"), text.lower_ascii(F.col("name")), "place_id")
    return hits.withColumn("match", match).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit).drop("nth")


def installed(spark: SparkSession, folders: dict[str, str], stage: str = "search") -> tuple[DataFrame | None, list[str]]:
    """(places with their region, regions left out) of prepared packages (region to folder): a damaged index keeps none of the others from being searched.

    An index counts if its manifest tells its rows and digest. None where no index does.
    """
    rows, out = None, []
    for region, folder in folders.items():
        try:
            whole = packages.valid_stage(spark, folder, stage)
        except (PySparkException, Py4JJavaError):  # files that can't be read
            whole = False
        if not whole:
            out.append(region)
            continue
        own = spark.read.parquet(f"{folder}/{stage}").select("place_id", "name", "kind", "rank", "lat_e7", "lon_e7", F.lit(region).alias("region"))
        rows = own if rows is None else rows.unionByName(own)
    return rows, out


def _first_come(rows: DataFrame, keys: list) -> DataFrame:
    """The rows that share no key with a kept row before them, in the order of (source_no, nth). Keys are texts, null for none.

    Rounds: what comes first under all its keys stays, and what shares one with it goes.
    """
    left, kept = stored(rows.withColumn("__keys", F.array_compact(F.array(*keys))).withColumn("__at", F.struct("source_no", "nth"))), None
    while not left.isEmpty():
        each = left.select("__at", F.explode("__keys").alias("key"))
        first = each.groupBy("key").agg(F.min("__at").alias("first"))
        late = each.join(first, "key").filter("__at <> first").select("__at").distinct()
        stays = stored(left.join(late, "__at", "left_anti").select(*left.columns))
        kept = stays if kept is None else kept.unionByName(stays)
        gone = each.join(stays.select(F.explode("__keys").alias("key")).distinct(), "key").select("__at").distinct()
        left = stored(left.join(gone, "__at", "left_anti").select(*left.columns))
    return (left if kept is None else kept).drop("__keys", "__at")


def world(places: DataFrame, bundled: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """The best places of all regions and of the bundled list: (place_id, name, kind, rank, lat_e7, lon_e7, region, bundled, match).

    Both inputs hold (place_id, name, kind, rank, lat_e7, lon_e7, region); place_id is that of the region. Each region and the list offer their
    `limit` best. They are taken region by region, the list last, unless a place taken before is the same: one id at one spot, one name
    at one spot, or, where one of the two is of the list, one normalised name in one region. Null regions are one
    region, the first, but never the same region for that rule. So the work behind the regions' own best is small whatever their size.
    """
    columns = ("place_id", "name", "kind", "rank", "lat_e7", "lon_e7", "region")
    hits = _hits(places.select(*columns), query, 2).withColumn("bundled", F.lit(False)).unionByName(_hits(bundled.select(*columns), query, 2).withColumn("bundled", F.lit(True)))
    order = Window.partitionBy("bundled", F.when(~F.col("bundled"), F.col("region"))).orderBy("match", F.desc("rank"), F.length("name"), text.lower_ascii(F.col("name")), "place_id", "lat_e7", "lon_e7")
    best = stored(hits.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit).withColumn("source_no", F.struct("bundled", F.when(~F.col("bundled"), F.col("region")).alias("region"))))
    key = lambda rule, *parts: F.concat_ws("\x1f", F.lit(rule), *[F.coalesce(F.col(p).cast("string"), F.lit("\x00")) for p in parts])
    same = [key("id", "place_id", "lat_e7", "lon_e7"), key("spot", "lat_e7", "lon_e7", "name")]
    named = F.when(F.col("region").isNotNull(), key("name", "region", "normalized"))
    own = stored(_first_come(best.filter("NOT bundled"), same))
    met = own.select(F.explode(F.array_compact(F.array(*same, named))).alias("__key")).distinct()
    listed = best.filter("bundled").withColumn("__keys", F.array_compact(F.array(*same, named)))
    known = listed.select("nth", F.explode("__keys").alias("__key")).join(met, "__key").select("nth").distinct()
    new = _first_come(listed.drop("__keys").join(known, "nth", "left_anti").select(*own.columns), [*same, named])
    rows = own.unionByName(new)
    return rows.orderBy("match", F.desc("rank"), F.length("normalized"), "name", "bundled", "region", "place_id").limit(limit).select(*columns, "bundled", "match")
