"""The ride as a stream against its batch form, whatever the batches, and both against the rules."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from wayfold.operators import matching, tracks
from wayfold.streaming import session, trips

SCHEMA = "trip long, kind string, route_no int, seq long, ts timestamp, lat double, lon double, speed_mps double, heading_deg double, dt_s double, at_m double, what string"
BEGIN = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
STEP = 0.0001  # some 11 m of latitude


def at(s):
    return BEGIN + dt.timedelta(seconds=s)


def point(trip, no, k, lat, lon, s):
    return (trip, "point", no, k, at(s), lat, lon, None, None, None, None, None)


def mark(trip, no, k, m, what, s):
    return (trip, "mark", no, k, at(s), None, None, None, None, None, m, what)


def sample(trip, k, lat, lon, s, speed=11.0, heading=0.0, step=1.0):
    return (trip, "sample", 0, k, at(s), lat, lon, speed, heading, step, None, None)


def north(trip, n, s0=0, lon=3.0, lat=50.0, first=1):
    return [sample(trip, first + k, lat + k * STEP, lon, s0 + k) for k in range(n)]


@pytest.fixture(scope="module")
def rows():
    out = []
    for trip in (1, 2, 3):  # a road of 2.2 km to the north
        out += [point(trip, 0, k, 50.0 + k * 0.005, 3.0, -2) for k in range(5)]
    out += [mark(1, 0, 0, 700.0, "LEFT", -2), mark(1, 0, 1, 2000.0, "ARRIVE", -2)]
    out += north(1, 200)
    # Trip 2: silent for eight seconds, then off to the east, asks for a new route, gets it and follows it.
    out += north(2, 10) + [sample(2, 11 + k, 50.001 + k * STEP, 3.0 + k * 2 * STEP, 18 + k) for k in range(20)]
    out += [point(2, 1, k, 50.0032, 3.004 + k * 0.004, 38) for k in range(3)]
    out += [sample(2, 40 + k, 50.0032, 3.0042 + k * 1.5 * STEP, 39 + k, heading=90.0) for k in range(25)]
    # Trip 3: a jump, a repeated row, no time, backwards, nothing finite, headings across north.
    out += [sample(3, 1, 50.0, 3.0, 0, heading=350.0), sample(3, 2, 50.0001, 3.0, 1, heading=10.0), sample(3, 2, 50.3, 3.0, 1), sample(3, 3, 50.0002, 3.0, 2, step=0.0), sample(3, 4, 50.02, 3.0, 3), sample(3, 5, float("nan"), 3.0, 4), sample(3, 6, 50.0201, 3.0, 5, step=-1.0, speed=-4.0)]
    out += north(4, 3)  # no route
    return out


def results(frame):
    return sorted((tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in frame.collect()), key=repr)


def streamed(spark, rows, cuts, folder, name):
    for k, (a, b) in enumerate(zip([-100, *cuts], [*cuts, 10**9], strict=True)):
        part = [r for r in rows if a <= (r[4] - BEGIN).total_seconds() < b]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part={k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*")
    query = session.follow(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    return results(spark.table(name))


def test_batches_of_any_cut_equal_the_table(spark, rows, tmp_path):
    want = results(session.replayed(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert [r for r in want if r[2] == "LOST"] == [r for r in want if r[0] == 2 and r[1] == 10 and r[2] == "LOST"] != []
    # Much later another trip moves the watermark: each silence is told by the timer.
    late = [*rows, sample(9, 1, 10.0, 10.0, 4000), sample(9, 2, 10.0, 10.0, 8000)]
    for k, cuts in enumerate([[3000], [5, 22, 30, 38, 60, 3000]]):
        got = streamed(spark, late, [*cuts, 6000], tmp_path / str(k), f"rides{k}")
        ends = {r for r in got if r[2] == "LOST"} - set(want)
        assert {(r[0], r[1], r[3] - int(BEGIN.timestamp() * 1000)) for r in ends if r[0] != 9} == {(1, 200, 204_000), (2, 64, 68_000), (3, 6, 10_000), (4, 3, 7_000)}
        assert sorted((r for r in got if r not in ends and r[0] != 9), key=repr) == want


def test_rules_of_the_session(spark, rows):
    found = session.replayed(spark.createDataFrame(rows, SCHEMA)).collect()
    of = lambda trip: sorted((r for r in found if r.trip == trip and r.event == "SAMPLE"), key=lambda r: r.seq)
    one = of(1)
    said = [(r.seq, s) for r in one for s in r.said.split(",") if s]
    names = [s for _, s in said]
    assert names.index("LEFT:far") < names.index("LEFT:near") < names.index("LEFT:now") and len(names) == len(set(names))
    assert one[-1].status in ("ON_ROUTE", "ARRIVED") and not any(r.reroute for r in one)
    assert one[-1].average_mps == pytest.approx(one[-1].way_m / one[-1].moving_s) and sum(r.recorded for r in one) > 90
    two = of(2)
    assert [r.seq for r in two if r.reroute] and "OFF_ROUTE" in {s for r in two for s in r.said.split(",")}
    after = [r for r in two if r.seq >= 45]
    assert all(r.status != "OFF_ROUTE" and r.distance_m < 25 for r in after) and after[0].reroutes == after[-1].reroutes > 0
    three = of(3)
    a = 1 - math.exp(-1 / 0.45)
    assert [r.seq for r in three] == [1, 2, 3, 4, 6] and three[1].heading_deg == pytest.approx((350 + 20 * a) % 360)
    assert (three[2].lat, three[3].lat, three[4].lat) == (50.0002, 50.02, 50.0201) and three[4].speed_mps == 0
    assert all(r.segment is None and r.status is None and not r.reroute for r in of(4))


def test_session_matches_what_it_filters(spark):
    """Filter, then match: the batch operators one after the other give the same."""
    track = [(5, k, round((50 + k * 0.00012) * 1e7), round((3 + (k % 7) * 0.00006) * 1e7), 1100 + k % 5 * 100, k * 13 % 40, 1) for k in range(1, 120)]
    frame = spark.createDataFrame(track, "trip long, seq int, lat_e7 long, lon_e7 long, speed_cms long, heading_deg int, dt_s int")
    smooth = tracks.filtered(frame)
    routes = spark.createDataFrame([(5, k, round((50 + k * 0.004) * 1e7), 30_000_000) for k in range(4)], "trip long, point int, lat_e7 long, lon_e7 long")
    rows = [point(5, 0, k, 50 + k * 0.004, 3.0, -2) for k in range(4)] + [sample(5, k, la / 1e7, lo / 1e7, k, v / 100, float(h)) for _, k, la, lo, v, h, _ in track]
    got = {r.seq: r for r in session.replayed(spark.createDataFrame(rows, SCHEMA)).collect()}
    exact = matching.matched(smooth.withColumns({"lat_e7": F.col("lat") * 1e7, "lon_e7": F.col("lon") * 1e7, "dt_s": F.lit(1.0)}), routes).collect()
    for r in exact:
        mine = got[r.seq]
        assert (mine.segment, mine.status, mine.reroute, mine.reroutes) == (r.segment, r.status, r.reroute, r.reroutes)
        assert (mine.distance_m, mine.travelled_m, mine.way_m) == pytest.approx((r.distance_m, r.travelled_m, r.way_m), abs=1e-4)
    for r in smooth.collect():
        assert (got[r.seq].lat, got[r.seq].lon, got[r.seq].speed_mps, got[r.seq].heading_deg) == pytest.approx((r.lat, r.lon, r.speed_mps, r.heading_deg), abs=1e-9)


def test_no_time_takes_the_sample():
    state = trips.advance(None, 1, 43.0, 1.0, 1.0, 5.0, 0.0)
    for step in (0.0, -1.0):
        assert trips.advance(state, 2, 43.001, 1.0, step, 5.0, 0.0)[1] == 43.001
    far = trips.advance(state, 2, 43.001, 1.0, 0.0, 5.0, 0.0)
    assert far[4] == 0.0  # 111 m in no time is no way
