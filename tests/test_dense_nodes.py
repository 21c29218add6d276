"""The nearest node where very many nodes lie in one wished cell."""

from pyspark.sql import functions as F

from wayfold.operators import spatial


def test_points_meet_few_of_many_nodes(spark, monkeypatch):
    """40,000 nodes in a single cell of the wished size: a point meets those around it, and finds the nearest as before."""
    k = F.col("id")
    nodes = spark.range(40_000).select(k.alias("node_id"), (F.lit(430_000_000) + F.floor(k / 200) * 5_000).alias("lat_e7"), (F.lit(10_000_000) + k % 200 * 5_000).alias("lon_e7"))
    points = spark.range(50).select(k.alias("point_id"), (F.lit(430_000_000) + 5_000 * (k % 7 + 90) + 1_900).alias("lat_e7"), (F.lit(10_000_000) + 5_000 * (k * 3 + 20) - 2_100).alias("lon_e7"))
    met, real = [], spatial.stored
    def stored(frame):
        out = real(frame)
        if "node_id" in out.columns and "n_lat" in out.columns:
            met.append(out.count())
        return out
    monkeypatch.setattr(spatial, "stored", stored)
    got = {r.point_id: r.node_id for r in spatial.nearest_node(points, nodes, 100_000_000).collect()}
    assert got == {p: (p % 7 + 90) * 200 + p * 3 + 20 for p in range(50)}
    assert met and sum(met) < 4_000
