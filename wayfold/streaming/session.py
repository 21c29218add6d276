"""A ride as one stream: filter, match, session, announcements, lost signal, recording and new routes, one state per trip.

The input is one stream of rows of three kinds: `point` (a point of a trip's route), `mark` (an instruction along
it) and `sample` (a position of the receiver). A row of a higher `route_no` than the state's starts a new route,
which is how a reroute comes back: a `reroute` in the output is a request to a routing batch, whose
route is written to the input. Rows are taken in order of time (at one time: points, marks, samples; then by number and place).

What a sample does is written once, in `Ride`; `follow` carries it between batches of a stream, `replayed` along a
sorted table, with the same rows as a result. The lost signal is an event-time timer in the stream: it fires when the
watermark is `LOST_S` past the last sample. If the next sample comes before that, the event is made up for
ahead of it, so how the stream is cut into batches changes nothing.

Cases: a sample without a finite position, or not newer than the last one, is passed over. Before a route of two points samples are filtered and
recorded, not matched. Steps of no or negative time take the sample as it is. A trip leaves the state `IDLE_S` after its last sample.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfold.operators import matching
from wayfold.operators.tracks import JUMP_M, metres_between

INPUT = ("trip", "kind", "route_no", "seq", "ts", "lat", "lon", "speed_mps", "heading_deg", "dt_s", "at_m", "what")
OUTPUT = (
    "trip long, seq long, event string, at_ms long, lat double, lon double, speed_mps double, heading_deg double, segment int, distance_m double, travelled_m double, remaining_m double, "
    "status string, reroute boolean, elapsed_s double, moving_s double, way_m double, average_mps double, top_mps double, reroutes int, said string, recorded boolean"
)
#: Seconds: smoothing of position, speed and heading; silence that counts as lost; how long an idle trip is kept.
POSITION_S, SPEED_S, HEADING_S, LOST_S, IDLE_S = 0.35, 0.55, 0.45, 5.0, 6 * 3600.0
RECORD_M, LATE = 10.0, "10 minutes"
#: How far ahead an instruction is announced: seconds at the speed driven, within metres.
STAGES = {"far": (20.0, 200.0, 600.0), "near": (8.0, 60.0, 180.0), "now": (2.0, 20.0, 45.0)}
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
_RANK = {"point": 0, "mark": 1, "sample": 2}
_ORDER = ["ts", "rank", "seq", "lat", "lon", "at_m"]


def share(dt: float, tau: float) -> float:
    """How much of the way to a new value is taken in dt seconds."""
    return 1 - math.exp(-dt / tau) if dt > 0 and tau > 0 and math.isfinite(dt) else 1.0


def blended(heading: float, target: float, alpha: float) -> float:
    """From one heading towards another by the shorter way."""
    turn = (target - heading) % 360
    return (heading + (turn - 360 if turn > 180 else turn) * alpha) % 360


class Ride:
    """What a trip carries from row to row; plain values only, so that it can be kept as JSON."""

    def __init__(self, kept: str | None = None):
        self.values = json.loads(kept) if kept else {
            "route_no": -1, "lat": [], "lon": [], "marks": [], "said": [], "was": None, "seq": None, "ms": None, "lost": True, "kept_m": None,
            "ride": {k: v for k, v in vars(matching.Ride()).items() if k not in ("lat", "lon", "route")},
        }
        self.route: matching.Route | None = None

    def as_json(self) -> str:
        return json.dumps(self.values)

    def row(self, kind: str, route_no: int, seq: int, ms: int, lat: float, lon: float, speed: float, heading: float, dt: float, at_m: float, what: str | None) -> list[tuple]:
        """The results of one more row."""
        v = self.values
        if kind == "sample":
            return self._sample(seq, ms, lat, lon, speed, heading, dt)
        if route_no > v["route_no"]:  # a new route
            v.update(route_no=route_no, lat=[], lon=[], marks=[], said=[])
            v["ride"].update(segment=None, off=False, off_for=0.0)
            self.route = None
        if route_no == v["route_no"]:
            if kind == "point":
                v["lat"].append(lat)
                v["lon"].append(lon)
                self.route = None
            else:
                v["marks"].append([at_m, what])
        return []

    def silent(self) -> list[tuple]:
        """The event of a lost signal, once for each silence."""
        v = self.values
        if v["lost"]:
            return []
        v["lost"] = True
        return [(v["seq"], "LOST", v["ms"] + int(LOST_S * 1000), *v["was"], *[None] * 14)]

    def _sample(self, seq: int, ms: int, lat: float, lon: float, speed: float, heading: float, dt: float) -> list[tuple]:
        v = self.values
        if not (math.isfinite(lat) and math.isfinite(lon)) or v["seq"] is not None and seq <= v["seq"]:
            return []
        events = self.silent() if v["ms"] is not None and ms - v["ms"] > LOST_S * 1000 else []
        speed, heading = speed if math.isfinite(speed) and speed > 0 else 0.0, heading % 360 if math.isfinite(heading) else 0.0
        now = (lat, lon, speed, heading)
        if v["was"] is not None and metres_between(*v["was"][:2], lat, lon) <= JUMP_M:
            y, x, s, h = v["was"]
            p = share(dt, POSITION_S)
            now = (y + (lat - y) * p, x + (lon - x) * p, s + (speed - s) * share(dt, SPEED_S), blended(h, heading, share(dt, HEADING_S)))
        v.update(was=list(now), seq=seq, ms=ms, lost=False)
        matched, said = self._matched(now, dt)
        metres = matched[2] if matched[2] is not None else matched[8]
        keep = v["kept_m"] is None or metres < v["kept_m"] or metres - v["kept_m"] >= RECORD_M
        v["kept_m"] = metres if keep else v["kept_m"]
        return [*events, (seq, "SAMPLE", ms, *now, *matched, ",".join(said), keep)]

    def _matched(self, now: tuple, dt: float) -> tuple[tuple, list[str]]:
        """(segment, metres off, travelled, remaining, status, reroute, elapsed, moving, way, average, top, reroutes) and what is said."""
        v = self.values
        ride = matching.Ride(**v["ride"])
        ride.last = tuple(ride.last) if ride.last else None
        ride.lat, ride.lon = v["lat"], v["lon"]
        if self.route is None and len(ride.lat) > 1:
            self.route = matching.Route(ride.lat, ride.lon)
        ride.route = self.route
        found, said = None, []
        if self.route is None:
            matching.ridden(ride, *now[:3], min(max(dt, 0.0), 5.0))
        else:
            found = matching.located(ride, *now, dt)
            said = self._said(found[5], found[3], now[2])
        v["ride"] = {k: x for k, x in vars(ride).items() if k not in ("lat", "lon", "route")}
        average = ride.metres / ride.moving if ride.moving > 0 else 0.0
        first = (found[0], *found[2:7]) if found else (None, None, None, None, None, False)
        return (*first, ride.elapsed, ride.moving, ride.metres, average, ride.top, ride.reroutes), said

    def _said(self, status: str, travelled: float, speed: float) -> list[str]:
        """What is announced now: each stage of the next instruction once; leaving the route and arriving once each, until the route is met again."""
        v, out = self.values, []
        for name in ("OFF_ROUTE", "ARRIVED"):
            if status == name and name not in v["said"]:
                v["said"].append(name)
                out.append(name)
        if status == "ON_ROUTE" and "OFF_ROUTE" in v["said"]:
            v["said"].remove("OFF_ROUTE")
        marks = v["marks"] if status == "ON_ROUTE" else []
        for k, (at_m, what) in enumerate(marks):
            gap = marks[k + 1][0] - at_m if k + 1 < len(marks) else None
            if at_m + (0.0 if gap is None else 2.5 if gap <= 50 else 3.5 if gap <= 100 else 5.0) < travelled:
                continue  # passed
            for stage, (seconds, low, high) in STAGES.items():
                if at_m - travelled <= min(high, max(low, seconds * min(60.0, speed))) and f"{k}:{stage}" not in v["said"]:
                    v["said"].append(f"{k}:{stage}")
                    out.append(f"{what}:{stage}")
            break
        return out


def _rows(frame: pd.DataFrame) -> Iterator[tuple]:
    """The rows of a frame, in order, as `Ride.row` takes them."""
    ms = (frame["ts"].astype("int64") // {"ns": 10**6, "us": 10**3, "ms": 1}[frame["ts"].dt.unit]).tolist() if len(frame) else []
    number = lambda c: frame[c].astype(float).tolist()
    return zip(frame["kind"].tolist(), frame["route_no"].fillna(0).astype(int).tolist(), frame["seq"].astype(int).tolist(), ms, number("lat"), number("lon"), number("speed_mps"), number("heading_deg"), number("dt_s"), number("at_m"), frame["what"].tolist(), strict=True)


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ride = Ride(state.get[0] if state.exists else None)
    out: list[tuple] = []
    if state.hasTimedOut:
        out = ride.silent()
        if not out:
            state.remove()
            return
    else:
        rows = pd.concat(list(frames))
        rows["rank"] = rows["kind"].map(_RANK)
        for row in _rows(rows.sort_values(_ORDER)):
            out += ride.row(*row)
    state.update((ride.as_json(),))
    v = ride.values
    wait = int((LOST_S if not v["lost"] else IDLE_S) * 1000)
    state.setTimeoutTimestamp(max((v["ms"] or state.getCurrentWatermarkMs()) + wait, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([(key[0], *r) for r in out], columns=_NAMES)


def follow(rows: DataFrame) -> DataFrame:
    """The stream of results of a stream of rows (see INPUT): one for each sample, and the events of lost signals."""
    keyed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).select(F.col("trip").cast("long").alias("trip"), *INPUT[1:]).groupBy("trip")
    return keyed.applyInPandasWithState(_update, OUTPUT, "ride string", "append", GroupStateTimeout.EventTimeTimeout)


def replayed(rows: DataFrame) -> DataFrame:
    """The same results for a table: rows are sorted by trip and time within partitions, and a trip's state goes from row to row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trip, ride = None, Ride()
        for frame in frames:
            out = []
            for key, row in zip(frame["trip"].tolist(), _rows(frame), strict=True):
                if key != trip:
                    trip, ride = key, Ride()
                out += [(trip, *r) for r in ride.row(*row)]
            yield pd.DataFrame(out, columns=_NAMES)

    rank = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in _RANK.items())).alias("rank")
    dealt = rows.select(F.col("trip").cast("long").alias("trip"), *INPUT[1:], rank).withColumn("ts", F.col("ts").cast("timestamp")).repartition("trip").sortWithinPartitions("trip", *_ORDER)
    return dealt.select(*INPUT).mapInPandas(run, OUTPUT)
