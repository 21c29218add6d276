"""Spoken distances against C's rounding."""

from pyspark.sql import functions as F

from wayfold.functions import text


def test_distances_round_as_printf(spark):
    """By the exact value, halves to even: 5550 m is a little under 5.55 km, 18500 m is 18 km."""
    metres = [1000 + 12.5 * k for k in range(8000)] + [9949.999, 9950.0, 9999.999, 10500.0, 11500.0]
    rows = spark.createDataFrame([(m,) for m in metres], "m double").select("m", text.distance_text(F.col("m")).alias("t")).collect()
    assert len(rows) == len(metres)
    assert [r.t for r in rows] == [f"{r.m / 1000:.1f} km" if r.m < 10000 else f"{r.m / 1000:.0f} km" for r in rows]
