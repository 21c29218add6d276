"""Map matching against plain loops, and its rules on small routes."""

import math

import numpy as np
import pytest

from wayfold.operators import matching, tracks

ROUTE = "trip long, point int, lat_e7 long, lon_e7 long"
SAMPLES = "trip long, seq int, lat_e7 long, lon_e7 long, speed_mps double, heading_deg double, dt_s double"


def e7(*degrees):
    return [round(d * 1e7) for d in degrees]


def plain_projection(route, i, lat, lon):
    (a, b), (c, d) = route[i], route[i + 1]
    k = math.cos(math.radians((lat + a + c) / 3))
    dx, dy = (d - b) * k, c - a
    n = dx * dx + dy * dy
    f = 0 if n <= 0 else min(1, max(0, ((lon - b) * k * dx + (lat - a) * dy) / n))
    return tracks.metres_between(lat, lon, a + (c - a) * f, b + (d - b) * f), f


def plain_match(route, samples):
    """(segment, off) of each sample by the rules, in plain loops; routes that are no loops and have few segments."""
    last, off, out = None, False, []
    for lat, lon, speed, heading in samples:
        found = [(*plain_projection(route, i, lat, lon), i) for i in range(len(route) - 1)]
        best = min(found, key=lambda x: (x[0], x[2]))
        if last is not None:
            turns = []
            for i in range(len(route) - 1):
                (a, b), (c, d) = route[i], route[i + 1]
                dl = math.radians(d - b)
                y = math.sin(dl) * math.cos(math.radians(c))
                x = math.cos(math.radians(a)) * math.sin(math.radians(c)) - math.sin(math.radians(a)) * math.cos(math.radians(c)) * math.cos(dl)
                t = abs(heading % 360 - math.degrees(math.atan2(y, x)) % 360)
                turns.append(min(t, 360 - t))
            sure = speed >= 2
            if not (best[0] <= 2 and (not sure or turns[best[2]] <= 35)):
                near = [c for c in found if c[0] <= best[0] + (33.75 if sure else 8)]
                best = min(near, key=lambda c: (c[0] + (0.6 * turns[c[2]] if sure else 0) + min(1.5 * abs(c[2] - last), 12) + (2 if c[2] < last else 0), c[2]))
        last = best[2]
        off = best[0] > (25 if off else 45)
        out.append((last, off))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_matches_equal_plain_loops(spark, seed):
    rng = np.random.default_rng(seed)
    route = [(43 + 0.0008 * k + 0.0004 * rng.normal(), 1 + 0.0009 * math.sin(k / 2)) for k in range(40)]
    samples = [(43 + 0.0004 * k + 0.0002 * rng.normal(), 1 + 0.0009 * math.sin(k / 4) + 0.0002 * rng.normal(), float(rng.integers(0, 9)), float(rng.integers(0, 360))) for k in range(70)]
    route = [(round(a, 7), round(b, 7)) for a, b in route]
    samples = [(round(a, 7), round(b, 7), s, h) for a, b, s, h in samples]
    got = matching.matched(
        spark.createDataFrame([(1, k, s, h, 1.0, *e7(a, b)) for k, (a, b, s, h) in enumerate(samples)], "trip long, seq int, speed_mps double, heading_deg double, dt_s double, lat_e7 long, lon_e7 long"),
        spark.createDataFrame([(1, k, *e7(*p)) for k, p in enumerate(route)], ROUTE),
    ).orderBy("seq").collect()
    assert [(r.segment, r.status == "OFF_ROUTE") for r in got] == plain_match(route, samples)


def test_arrival_reroute_and_session(spark):
    route = spark.createDataFrame([(1, k, *e7(43.0, 1 + 0.001 * k)) for k in range(11)] + [(2, 0, *e7(43, 1))], ROUTE)
    rows = [(1, 0, *e7(43.0, 1.0), 10.0, 90.0, 1.0), (1, 1, *e7(43.0, 1.002), 0.5, 90.0, 9.0), (1, 2, *e7(43.002, 1.003), 10.0, 90.0, 1.0), (1, 3, *e7(43.002, 1.004), 10.0, 90.0, 1.5), (1, 4, *e7(43.0003, 1.005), 10.0, 90.0, 1.0),
            (1, 5, *e7(43.0, 1.0099), 10.0, 90.0, 1.0), (2, 0, *e7(43, 1), 0.0, 0.0, 1.0), (3, 0, *e7(43, 1), 0.0, 0.0, 1.0)]
    got = matching.matched(spark.createDataFrame(rows, SAMPLES), route).orderBy("seq").collect()
    assert [r.status for r in got] == ["ON_ROUTE", "ON_ROUTE", "OFF_ROUTE", "OFF_ROUTE", "OFF_ROUTE", "ARRIVED"]
    assert [r.reroute for r in got] == [False, False, False, True, False, False] and got[-1].reroutes == 1
    assert got[-1].elapsed_s == 1 + 5 + 1 + 1.5 + 1 + 1 and got[-1].moving_s == got[-1].elapsed_s - 5 and got[-1].remaining_m < 25
    assert got[1].way_m == pytest.approx(tracks.metres_between(43, 1, 43, 1.002)) and {r.trip for r in got} == {1}


def test_a_loop_begins_at_its_beginning(spark):
    """At the common point of a loop's ends the first sample has no way behind it."""
    corners = [(43 + 0.005 * math.sin(k / 30 * 2 * math.pi), 1 + 0.005 * (1 - math.cos(k / 30 * 2 * math.pi))) for k in range(31)]
    route = spark.createDataFrame([(1, k, *e7(*p)) for k, p in enumerate(corners)], ROUTE)
    first = spark.createDataFrame([(1, 0, *e7(43.0 - 0.00001, 1.0), 5.0, 0.0, 1.0)], SAMPLES)
    assert matching.matched(first, route).collect()[0].travelled_m < 50
