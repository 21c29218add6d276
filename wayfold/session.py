"""Session and table helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "wayfold", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; a temporary one only in a local session that names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def saved(frame: DataFrame) -> DataFrame:
    """The frame, written to the checkpoint folder and read from there."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


#: Spark's setting by which a query's shuffle files go when it is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table of the checkpoint folder, for states that grow out of each other.

    Plans see the size of its files. A checkpoint hands on the estimate of the plan behind it, which multiplies by every join: it
    doubles its digits each round, until working it out takes longer than the round. The shuffle files of what led there go.
    """
    spark, folder = frame.sparkSession, f"{shared_folder(frame.sparkSession)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        frame.write.parquet(folder)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(frame.schema).parquet(folder)
    out.stored_in = folder
    return out


def unstored(*frames: DataFrame | None) -> None:
    """Remove the files of stored frames that nothing reads any more."""
    from wayfold.sources import folders

    for frame in frames:
        if folder := frame is not None and frame.__dict__.get("stored_in"):
            folders.removed(frame.sparkSession, folder)
