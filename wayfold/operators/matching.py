"""Matching positions to routes: nearest segment with heading and continuity, off-route and arrival, and the session around it.

A trip's route and samples are one ordered stream: first the route's points, then the
samples. `tracks.folded` carries the state of one trip from row to row, so memory is that
trip's route, whatever the number of samples.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import tracks

# Metres, segments and seconds of the matching rules.
OFF_M, ON_M, ARRIVAL_M, RADIUS = 45.0, 25.0, 25.0, 80
AMBIGUOUS_M = min(max(OFF_M * 0.75, 12.0), 35.0)
CONFIRM_S, COOLDOWN_S, TOP_MPS = 2.0, 8.0, 70.0
_BEFORE = 1 << 40  # route points come before samples


class Route:
    """A route's segments, with the way to the beginning of each and their headings."""

    def __init__(self, lat: list[float], lon: list[float]):
        self.lat, self.lon = np.array(lat), np.array(lon)
        p, q = np.radians(self.lat[:-1]), np.radians(self.lat[1:])
        d = np.radians(np.diff(self.lon))
        a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(d / 2) ** 2
        self.way = np.concatenate(([0.0], np.cumsum(2 * geo.EARTH_M * np.arctan2(np.sqrt(a), np.sqrt(np.abs(1 - a))))))
        self.heading = np.degrees(np.arctan2(np.sin(d) * np.cos(q), np.cos(p) * np.sin(q) - np.sin(p) * np.cos(q) * np.cos(d))) % 360
        self.total = float(self.way[-1])
        ends = tracks.metres_between(lat[0], lon[0], lat[-1], lon[-1])
        self.loop = ends <= max(100.0, 4 * ARRIVAL_M)
        self.start_window = min(max(0.05 * self.total, 250.0), 1000.0)

    def projected(self, lat: float, lon: float, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(metres, fraction) of a position on segments first to last, on the plane at the mean latitude of the position and both ends."""
        a_lat, b_lat, a_lon, b_lon = self.lat[first : last + 1], self.lat[first + 1 : last + 2], self.lon[first : last + 1], self.lon[first + 1 : last + 2]
        k = np.cos(np.radians((lat + a_lat + b_lat) / 3))
        dx, dy, px, py = (b_lon - a_lon) * k, b_lat - a_lat, (lon - a_lon) * k, lat - a_lat
        length2 = dx * dx + dy * dy
        f = np.where(length2 > 0, np.clip((px * dx + py * dy) / np.where(length2 > 0, length2, 1), 0, 1), 0)
        m_lat, m_lon = a_lat + (b_lat - a_lat) * f, a_lon + (b_lon - a_lon) * f
        p, q, d = np.radians(lat), np.radians(m_lat), np.radians(m_lon - lon)
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(d / 2) ** 2
        return 2 * geo.EARTH_M * np.arctan2(np.sqrt(h), np.sqrt(np.abs(1 - h))), f

    def nearest(self, lat: float, lon: float, first: int, last: int) -> tuple[int, float, float]:
        """(segment, fraction, metres): the nearest of a range, the first of equals."""
        far, f = self.projected(lat, lon, first, last)
        k = int(far.argmin())
        return first + k, float(f[k]), float(far[k])

    def likely(self, lat: float, lon: float, first: int, last: int, before: int, speed: float, heading: float) -> tuple[int, float, float]:
        """The nearest of a range, unless others are about as near: then heading and continuity decide."""
        far, f = self.projected(lat, lon, first, last)
        k = int(far.argmin())
        sure = speed >= 2.0
        turn = np.abs(heading % 360 - self.heading[first : last + 1])
        turn = np.where(turn > 180, 360 - turn, turn)
        if far[k] <= 2.0 and (not sure or turn[k] <= 35):
            return first + k, float(f[k]), float(far[k])
        steps = np.arange(first, last + 1) - before
        score = far + (0.6 * turn if sure else 0) + np.minimum(1.5 * np.abs(steps), 12.0) + np.where(steps < 0, 2.0, 0)
        score = np.where(far <= far[k] + (AMBIGUOUS_M if sure else min(8.0, AMBIGUOUS_M)), score, np.inf)
        k = int(score.argmin())
        return first + k, float(f[k]), float(far[k])

    def match(self, lat: float, lon: float, before: int | None, speed: float, heading: float) -> tuple[int, float, float]:
        n = len(self.way) - 1
        if before is None:
            got = self.nearest(lat, lon, 0, n - 1)
        elif n <= 2 * RADIUS + 1:
            got = self.likely(lat, lon, 0, n - 1, before, speed, heading)
        else:
            got = self.likely(lat, lon, max(0, before - RADIUS), min(n - 1, before + RADIUS), before, speed, heading)
            if got[2] > 2 * OFF_M:
                got = self.nearest(lat, lon, 0, n - 1)
        if self.loop and (before is None or self.way[before] <= self.start_window):
            last = 0  # near the beginning of a loop, its end is no answer
            while last + 1 < n and self.way[last + 1] <= self.start_window:
                last += 1
            begin = self.nearest(lat, lon, 0, last)
            if begin[2] <= max(150.0, 3 * OFF_M):
                return begin
        return got


@dataclass
class Ride:
    """What a trip carries from sample to sample."""

    lat: list[float] = field(default_factory=list)
    lon: list[float] = field(default_factory=list)
    route: Route | None = None
    segment: int | None = None
    off: bool = False
    elapsed: float = 0.0
    moving: float = 0.0
    metres: float = 0.0
    top: float = 0.0
    off_for: float = 0.0
    cooldown: float = 0.0
    reroutes: int = 0
    last: tuple[float, float] | None = None


def ridden(ride: Ride, lat: float, lon: float, speed: float, dt: float) -> None:
    """Time, way and speed of the session; jumps are no way."""
    ride.elapsed += dt
    ride.moving += dt if speed >= 1.0 else 0.0
    if ride.last is not None:
        step = tracks.metres_between(*ride.last, lat, lon)
        ride.metres += step if step <= max(35.0, TOP_MPS * max(dt, 0.2)) else 0.0
    ride.last, ride.top = (lat, lon), max(ride.top, speed)
    ride.cooldown = max(0.0, ride.cooldown - dt)


def _rerouted(ride: Ride, status: str, dt: float) -> bool:
    """Whether a new route is due: off the route for some seconds, and some more after the last one."""
    ride.off_for = ride.off_for + dt if status == "OFF_ROUTE" else 0.0
    if ride.cooldown > 0 or ride.off_for < CONFIRM_S:
        return False
    ride.reroutes, ride.off_for, ride.cooldown, ride.last = ride.reroutes + 1, 0.0, COOLDOWN_S, None
    return True


def step(ride: Ride | None, now: tuple) -> tuple[Ride, tuple | None]:
    """One row: a route point is kept, a sample is matched."""
    ride = ride or Ride()
    is_point, lat, lon, speed, heading, dt = now[0], now[1] / 1e7, now[2] / 1e7, now[3], now[4], now[5]
    if is_point:
        ride.lat.append(lat)
        ride.lon.append(lon)
        return ride, None
    if len(ride.lat) < 2:
        return ride, None
    if ride.route is None:
        ride.route = Route(ride.lat, ride.lon)
    return ride, located(ride, lat, lon, speed, heading, dt)


def located(ride: Ride, lat: float, lon: float, speed: float, heading: float, dt: float) -> tuple:
    """A sample on the ride's route, and the session after it: the values of RESULT."""
    route, dt = ride.route, min(max(dt, 0.0), 5.0)
    segment, fraction, far = route.match(lat, lon, ride.segment, speed, heading)
    ride.segment = segment
    done = float(route.way[segment] + (route.way[segment + 1] - route.way[segment]) * fraction)
    done = min(max(done, 0.0), route.total)
    ride.off = far > (ON_M if ride.off else OFF_M)
    status = "OFF_ROUTE" if ride.off else "ARRIVED" if route.total - done <= ARRIVAL_M else "ON_ROUTE"
    ridden(ride, lat, lon, speed, dt)
    asked = _rerouted(ride, status, dt)
    return segment, fraction, far, done, max(0.0, route.total - done), status, asked, ride.elapsed, ride.moving, ride.metres, ride.top, ride.reroutes


RESULT = "segment int, fraction double, distance_m double, travelled_m double, remaining_m double, status string, reroute boolean, elapsed_s double, moving_s double, way_m double, top_mps double, reroutes int"


def matched(samples: DataFrame, routes: DataFrame) -> DataFrame:
    """(trip, seq, segment, ...) of samples (trip, seq, lat_e7, lon_e7, speed_mps, heading_deg, dt_s) on the routes (trip, point, lat_e7, lon_e7) of their trips.

    A sample of a trip without a route of two points has no row.
    """
    none = F.lit(0.0)
    points = routes.select("trip", (F.col("point").cast("long") - _BEFORE).alias("seq"), F.lit(True).alias("is_point"), "lat_e7", "lon_e7", none.alias("speed_mps"), none.alias("heading_deg"), none.alias("dt_s"))
    rows = samples.select("trip", F.col("seq").cast("long").alias("seq"), F.lit(False).alias("is_point"), "lat_e7", "lon_e7", *[F.col(c).cast("double").alias(c) for c in ("speed_mps", "heading_deg", "dt_s")])
    return tracks.folded(points.unionByName(rows), step, ["is_point", "lat_e7", "lon_e7", "speed_mps", "heading_deg", "dt_s"], RESULT)
