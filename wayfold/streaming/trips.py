"""Live positions as a stateful stream: filter, hysteresis and trip totals, one state per trip.

The state is small and fixed: the last position, the off-route flag and four totals. A
sample older than the state is dropped, so replays give the same result; batches of any
cut give the same output. A trip leaves the state when the watermark (`LATE` behind the
newest sample) is `IDLE_MS` past its last sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "trip long, seq int, lat double, lon double, off boolean, distance_m double, elapsed_s double, moving_s double, top_mps double"
STATE = "seq int, lat double, lon double, off boolean, distance_m double, elapsed_s double, moving_s double, top_mps double"
TAU_S, JUMP_M, OFF_M, ON_M, IDLE_MS = 0.35, 350.0, 45.0, 25.0, 6 * 3600 * 1000
LATE = "10 minutes"
EARTH_M = 6371008.8


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * math.atan2(math.sqrt(a), math.sqrt(abs(1 - a)))


def advance(state: tuple | None, seq: int, lat: float, lon: float, dt: float, mps: float, off_m: float) -> tuple:
    """The state after one more sample."""
    if state is None:
        return (seq, lat, lon, off_m > OFF_M, 0.0, dt, dt if mps >= 1 else 0.0, mps)
    _, old_lat, old_lon, off, way, elapsed, moving, top = state
    if metres(old_lat, old_lon, lat, lon) <= JUMP_M:
        alpha = 1 - math.exp(-dt / TAU_S) if dt > 0 else 1.0
        lat, lon = old_lat + (lat - old_lat) * alpha, old_lon + (lon - old_lon) * alpha
    step = metres(old_lat, old_lon, lat, lon)
    way += step if step <= max(35.0, 70.0 * max(dt, 0.2)) else 0.0
    off = True if off_m > OFF_M else False if off_m <= ON_M else off
    return (seq, lat, lon, off, way, elapsed + dt, moving + (dt if mps >= 1 else 0.0), max(top, mps))


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(frames)).sort_values("seq")
    now = tuple(state.get) if state.exists else None
    out, last_ms = [], state.getCurrentWatermarkMs() + 1
    for r in rows.itertuples(index=False):
        if now is not None and r.seq <= now[0]:
            continue
        last_ms = max(last_ms, int(r.ts.timestamp() * 1000))
        now = advance(now, int(r.seq), float(r.lat), float(r.lon), float(r.dt_s), float(r.speed_mps), float(r.off_m))
        out.append((key[0], *now))
    if now is not None:
        state.update(now)
        state.setTimeoutTimestamp(last_ms + IDLE_MS)
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def follow(samples: DataFrame) -> DataFrame:
    """The stream of samples (trip, seq, ts, lat, lon, dt_s, speed_mps, off_m) with each sample's state behind it."""
    keyed = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).select(F.col("trip").cast("long").alias("trip"), "seq", "ts", "lat", "lon", "dt_s", "speed_mps", "off_m").groupBy("trip")
    return keyed.applyInPandasWithState(_update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
