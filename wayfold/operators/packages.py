"""What is prepared once and kept: signed tables, gateways between regions, and the stages of a region's package.

A table that is kept has a signature of what it was made from, and is written aside and then
renamed, so a reader meets a whole table or none, and a job that is killed resumes at the stage that is missing.
Signatures cover every row: 60 bits of each row's digest, summed, so neither the order of rows nor
their partitions matter and one aggregation with partial sums makes one.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import spatial
from wayfold.sources import folders

VERSION = 1
NODE, EDGE = ("node_id", "lat_e7", "lon_e7"), ("src", "dst", "length_cm", "flags", "road_class", "max_speed_kph")
_SUM = "decimal(38,0)"


def row_digest(columns: tuple[str, ...] | list[str]) -> Column:
    """60 bits of the md5 of a row's values as text; null is told from empty."""
    texts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 15), 16, 10).cast("long")


def table_digest(rows: DataFrame, columns: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """(rows, digest), one row: how many rows there are and the sum of their digests modulo 2^60. Without columns: all, by name."""
    total = F.coalesce(F.sum(row_digest(columns or sorted(rows.columns)).cast("decimal(19,0)")), F.lit(0)).cast(_SUM)
    return rows.agg(F.count("*").alias("rows"), (total % F.lit(1 << 60)).cast("long").alias("digest"))


def graph_signature(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(signature), one row: of a format version and of all nodes and edges."""
    n, e = table_digest(nodes, NODE), table_digest(edges, EDGE)
    both = n.select(F.concat_ws("|", F.lit(VERSION), "rows", "digest").alias("n")).crossJoin(e.select(F.concat_ws("|", "rows", "digest").alias("e")))  # one row each
    return both.select(F.md5(F.concat_ws("|", "n", "e")).alias("signature"))


# Gateways ------------------------------------------------------------------------------------------


def _pair(folder: str, a: str, b: str) -> str:
    return f"{folder}/" + "--".join(quote(x, safe="").replace("-", "%2D") for x in sorted((a, b)))


def _known(rows: DataFrame, side: str, nodes: DataFrame) -> bool:
    """Whether every gateway's node stands in the graph where the gateway says."""
    at = nodes.select(F.col("node_id").alias(side), "lat_e7", "lon_e7")
    return rows.join(at, [side, "lat_e7", "lon_e7"], "left_anti").isEmpty()


def cached_gateways(spark: SparkSession, folder: str, left: tuple[str, DataFrame, DataFrame], right: tuple[str, DataFrame, DataFrame]) -> tuple[DataFrame, str]:
    """(gateways, state) of two regions (name, nodes, edges): `spatial.gateways`, from the cache where it still holds.

    A pair is kept once, for both directions, under the signatures of both graphs. It is `read` if both
    signatures are those of the graphs and every gateway's place is right on both sides; otherwise all of the pair
    goes and it is `built` anew. Where the cache can't be written the gateways are `computed` all the same.
    """
    (a, *graph_a), (b, *graph_b) = sorted((left, right), key=lambda region: region[0])
    if a == b:
        raise ValueError(f"a region has no boundary with itself: {a}")
    signs = [graph_signature(*graph).collect()[0].signature for graph in (graph_a, graph_b)]
    pair = _pair(folder, a, b)
    kept = f"{pair}/{signs[0]}-{signs[1]}"
    state = "built"
    if folders.exists(spark, f"{kept}/_SUCCESS"):
        rows = spark.read.parquet(kept)
        if _known(rows, "left_node", graph_a[0]) and _known(rows, "right_node", graph_b[0]):
            state = "read"
    if state == "built":
        classed = [n.join(spatial.best_classes(e), "node_id") for n, e in (graph_a, graph_b)]
        rows, part = spatial.gateways(*classed), f"{pair}.part-{uuid.uuid4().hex}"
        try:
            folders.removed(spark, pair)
            rows.write.parquet(part)
            if not folders.moved(spark, part, kept):  # another job was first, from the same graphs
                folders.removed(spark, part)
            rows = spark.read.parquet(kept)
        except Exception as failed:  # whatever keeps the cache from being written: a fault of the gateways themselves shows when they are read
            warnings.warn(f"gateways of {a} and {b} not kept: {failed}", stacklevel=2)
            state = "computed"
    if a != left[0]:
        rows = rows.select(F.col("right_node").alias("left_node"), F.col("left_node").alias("right_node"), "lat_e7", "lon_e7", "penalty_m")
    return rows, state


def boundary_candidates(spark: SparkSession, folder: str, left: tuple[str, DataFrame, DataFrame], right: tuple[str, DataFrame, DataFrame], start: tuple[float, float], goal: tuple[float, float], k: int = 8) -> DataFrame:
    """The k gateways of least detour between two regions, from the cache if it holds."""
    return spatial.top_gateways(cached_gateways(spark, folder, left, right)[0], start, goal, k)


def forget_gateways(spark: SparkSession, folder: str, region: str) -> list[str]:
    """Remove every pair of a region from the cache, as its graph is replaced or goes; the folders removed."""
    name = quote(region, safe="").replace("-", "%2D")
    gone = [f for f in folders.names(spark, folder) if name in f.partition(".part-")[0].split("--")]
    for f in gone:
        folders.removed(spark, f"{folder}/{f}")
    return gone


# Packages ------------------------------------------------------------------------------------------

Stage = tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]


def _manifest(rows: DataFrame) -> DataFrame:
    return table_digest(rows).withColumn("version", F.lit(VERSION))


def valid_stage(spark: SparkSession, folder: str, stage: str) -> bool:
    """Whether a stage's table and manifest are both there, and the table has the rows and the digest that the manifest tells."""
    if not all(folders.exists(spark, f"{folder}/{name}/_SUCCESS") for name in (stage, f"{stage}.manifest")):
        return False
    return _manifest(spark.read.parquet(f"{folder}/{stage}")).exceptAll(spark.read.parquet(f"{folder}/{stage}.manifest")).isEmpty()


def prepared(spark: SparkSession, folder: str, stages: list[Stage], region: str | None = None, gateways: str | None = None) -> DataFrame:
    """(nth, stage, state, rows, digest): bring a region's package up to date, one stage after the other.

    A stage is (name, function of the tables before it). One that is valid and follows only such ones is `kept`.
    Another is `built`: it and all behind it go first, for a stale table must not stand beside a new one; then its table
    is written aside and renamed, and its manifest after it. When the first stage (the roads) is built, the region's
    gateways in the folder `gateways` go as well. A stage that fails leaves those before it as they are.
    """
    done: dict[str, DataFrame] = {}
    states, fresh = [], True
    for k, (name, made) in enumerate(stages):
        fresh = fresh and valid_stage(spark, folder, name)
        if not fresh:
            for later, _ in stages[k:]:
                for suffix in ("", ".manifest", ".part", ".manifest.part"):
                    folders.removed(spark, f"{folder}/{later}{suffix}")
            if k == 0 and region and gateways:
                forget_gateways(spark, gateways, region)
            try:
                made(done).write.parquet(f"{folder}/{name}.part")
                _manifest(spark.read.parquet(f"{folder}/{name}.part")).coalesce(1).write.parquet(f"{folder}/{name}.manifest.part")
            except BaseException:
                for suffix in (".part", ".manifest.part"):
                    folders.removed(spark, f"{folder}/{name}{suffix}")
                raise
            folders.moved(spark, f"{folder}/{name}.part", f"{folder}/{name}")
            folders.moved(spark, f"{folder}/{name}.manifest.part", f"{folder}/{name}.manifest")
        done[name] = spark.read.parquet(f"{folder}/{name}")
        told = spark.read.parquet(f"{folder}/{name}.manifest").collect()[0]
        states.append((k + 1, name, "kept" if fresh else "built", told.rows, told.digest))
    return spark.createDataFrame(states, "nth int, stage string, state string, rows long, digest long")
