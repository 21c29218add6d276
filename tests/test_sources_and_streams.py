"""GPX there and back, and the stateful stream against a plain fold and the batch operators."""

from pyspark.sql import functions as F

from wayfold.operators import tracks
from wayfold.sources import geo_tables, gpx
from wayfold.streaming import trips

SF = "/root/testdata/sf0.001"


def test_gpx(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(
        '<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="50.1" lon="3.1"><name>Sortie &amp; test</name></wpt>'
        '<rte><rtept lat="50.2" lon="3.2"/><rtept lat="50.3" lon="3.3"/></rte>'
        '<trk><trkseg><trkpt lat="50.4" lon="3.4"><ele>42.5</ele></trkpt><trkpt lat="95" lon="3.5"/></trkseg><trkseg><trkpt lat="50.6" lon="3.6"/></trkseg></trk></gpx>'
    )
    rows = gpx.read(spark, str(tmp_path)).orderBy("kind", "part", "segment", "seq").collect()
    assert [(r.kind, r.segment, r.lat) for r in rows] == [("rte", 0, 50.2), ("rte", 0, 50.3), ("trk", 0, 50.4), ("trk", 1, 50.6), ("wpt", 0, 50.1)]
    assert rows[-1].name == "Sortie & test" and rows[2].ele == 42.5
    points = spark.createDataFrame([(1, k, 50.0 + k / 10, 3.0, "a < b") for k in range(3)], "trip long, seq int, lat double, lon double, name string")
    (doc,) = gpx.documents(points).collect()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.gpx").write_text(doc.gpx)
    assert [r.lat for r in gpx.read(spark, str(tmp_path / "b")).orderBy("seq").collect()] == [50.0, 50.1, 50.2]


def test_stream_equals_fold(spark, tmp_path):
    track = geo_tables.track(spark, SF).filter("trip < 5")
    samples = track.select("trip", "seq", "ts", (F.col("lat_e7") / 1e7).alias("lat"), (F.col("lon_e7") / 1e7).alias("lon"), F.col("dt_s").cast("double").alias("dt_s"), (F.col("speed_cms") / 100).alias("speed_mps"), (F.col("event_id") * 7919 % 90).cast("double").alias("off_m"))
    for k in range(3):  # three batches, in order of seq
        samples.filter(f"(seq - 1) DIV 4 = {k}" if k < 2 else "(seq - 1) DIV 4 >= 2").coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    query = trips.follow(stream).writeStream.format("memory").queryName("followed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(150)
    got = {(r.trip, r.seq): tuple(r)[1:] for r in spark.sql("SELECT * FROM followed").collect()}
    want, state = {}, {}
    for r in samples.orderBy("trip", "seq").collect():
        state[r.trip] = trips.advance(state.get(r.trip), r.seq, *tuple(r)[3:])
        want[r.trip, r.seq] = state[r.trip]
    assert got == want
    batch = {(r.trip, r.seq): (r.lat, r.lon) for r in tracks.filtered(track).collect()}
    assert all(abs(batch[k][0] - v[1]) < 1e-9 and abs(batch[k][1] - v[2]) < 1e-9 for k, v in want.items())
    off = {(r.trip, r.seq): r.off for r in tracks.off_route(samples.withColumnRenamed("off_m", "distance_m")).collect()}
    assert all(off[k] == v[3] for k, v in want.items())
