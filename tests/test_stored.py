"""Tables of the checkpoint folder that states grow out of."""

import os

from pyspark.sql import functions as F

from wayfold.session import stored, unstored


def test_estimates_do_not_grow_with_rounds(spark):
    """A state joined with itself doubles the digits of its estimate each round, unless it is read with its own size."""
    state = stored(spark.range(64).withColumn("to", (F.col("id") + 1) % 64))
    for _ in range(6):
        state = stored(state.join(state.select(F.col("id").alias("to"), F.col("to").alias("further")), "to").select("id", F.col("further").alias("to")))
    assert int(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 20
    assert sorted(map(tuple, state.collect())) == [(k, (k + 64) % 64) for k in range(64)]


def test_stored_keeps_types_and_leaves_settings(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    rows = spark.createDataFrame([(1, [(2, None)], {"a": 1.5}), (None, None, None)], "k int, s array<struct<x: long, y: string>>, m map<string, double>")
    kept = stored(rows)
    assert kept.schema.simpleString() == rows.schema.simpleString() and kept.count() == 2 and stored(rows.limit(0)).count() == 0
    assert spark.conf.get(name, None) == before
    folder = kept.stored_in.removeprefix("file:")
    assert os.path.isdir(folder)
    unstored(kept, None, rows)
    assert not os.path.exists(folder)
