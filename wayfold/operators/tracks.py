"""GPS tracks and trips: running sums, islands, filters and stateful folds in SQL functions.

The folds (location filter, recording) run over a trip's samples in order: rows are sorted by
trip within partitions and a small state is carried from row to row, so that memory is one
batch whatever a trip's length; the streaming form in `wayfold.streaming.trips` keeps the
same state between batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo

JUMP_M, OFF_M, ON_M = 350.0, 45.0, 25.0


def _order(*columns: str) -> Window:
    return Window.partitionBy("trip").orderBy(*columns)


def step_m(order: Window) -> Column:
    """Metres from the sample before, 0 for the first."""
    lat, lon = F.col("lat_e7") / 1e7, F.col("lon_e7") / 1e7
    return F.coalesce(geo.haversine_m(F.lag(lat).over(order), F.lag(lon).over(order), lat, lon), F.lit(0.0))


def cumulative(track: DataFrame, seq: str = "seq") -> DataFrame:
    """The track with step_m and total_m, the way so far."""
    order = _order(seq)
    return track.withColumn("step_m", step_m(order)).withColumn("total_m", F.sum("step_m").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def islands(track: DataFrame, starts: Column) -> DataFrame:
    """The track with `island`: its number counts the starts so far."""
    return track.withColumn("island", F.sum(starts.cast("int")).over(_order("seq").rowsBetween(Window.unboundedPreceding, 0)))


def longest_island(track: DataFrame, starts: Column, least_points: int = 2) -> DataFrame:
    """(trip, island, points): a trip's island of most points, the first of equals."""
    sizes = islands(track, starts).groupBy("trip", "island").agg(F.count("*").alias("points")).filter(F.col("points") >= least_points)
    return sizes.groupBy("trip").agg(F.max_by(F.struct("island", "points"), F.struct("points", -F.col("island"))).alias("b")).select("trip", "b.island", "b.points")


def trip_stats(track: DataFrame) -> DataFrame:
    """(trip, elapsed_s, moving_s, distance_m, top_speed_cms); a step counts as way up to max(35, 70 dt) metres, others are jumps."""
    order = _order("seq")
    rows = track.withColumn("step", step_m(order)).withColumn("first", F.row_number().over(order) == 1)
    counted = F.when(~F.col("first") & (F.col("step") <= F.greatest(F.lit(35.0), 70.0 * F.greatest(F.col("dt_s"), F.lit(0.2)))), F.col("step")).otherwise(0.0)
    return rows.groupBy("trip").agg(
        F.sum("dt_s").alias("elapsed_s"),
        F.sum(F.when(F.col("speed_cms") >= 100, F.col("dt_s")).otherwise(0)).alias("moving_s"),
        F.sum(counted).alias("distance_m"),
        F.max("speed_cms").alias("top_speed_cms"),
    )


def quality(accuracy_m: Column, age_s: Column, on: Column) -> Column:
    """What a receiver's state is called."""
    return F.when(~on, "OFF").when(age_s > 5, "LOST").when((accuracy_m <= 0) | (accuracy_m > 50), "POOR").when(accuracy_m > 20, "FAIR").otherwise("GOOD")


def off_route(samples: DataFrame, off_m: float = OFF_M, on_m: float = ON_M) -> DataFrame:
    """samples (trip, seq, distance_m) with `off`: off beyond `off_m`, on again within `on_m`, else as before.

    Between the two bounds a sample keeps the last decided state, so the fold is the last
    non-null decision: a window, not a loop.
    """
    decided = F.when(F.col("distance_m") > off_m, True).when(F.col("distance_m") <= on_m, False)
    return samples.withColumn("off", F.coalesce(F.last(decided, ignorenulls=True).over(_order("seq").rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))


def metres_between(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Great-circle metres of one pair, as `geo.haversine_m`."""
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_M * math.atan2(math.sqrt(a), math.sqrt(abs(1 - a)))


def folded(rows: DataFrame, step: Callable, columns: list[str], out: str, order: str = "seq") -> DataFrame:
    """(trip, order, out...): `step(state, values)` over each trip's rows in order gives the next state and the row's result, None for no row.

    `columns` are the values; the state of a trip begins as None.
    """
    names = [c.strip().split(" ")[0] for c in out.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trip, state = None, None
        for frame in frames:
            got = []
            for row in zip(frame["trip"].tolist(), frame[order].tolist(), *(frame[c].tolist() for c in columns), strict=True):
                if row[0] != trip:
                    trip, state = row[0], None
                state, result = step(state, row[2:])
                if result is not None:
                    got.append((*row[:2], *result))
            yield pd.DataFrame(got, columns=["trip", order, *names])

    kinds = dict(rows.dtypes)
    dealt = rows.select("trip", order, *columns).repartition("trip").sortWithinPartitions("trip", order)
    return dealt.mapInPandas(run, f"trip {kinds['trip']}, {order} {kinds[order]}, {out}")


def filtered(track: DataFrame, tau_s: float = 0.35, speed_tau_s: float = 0.55, heading_tau_s: float = 0.45) -> DataFrame:
    """(trip, seq, lat, lon, speed_mps, heading_deg): smoothed with factors 1 - exp(-dt/tau), headings by the shorter way; a jump resets to the sample."""

    def step(last, now):
        lat, lon, dt, speed, heading = now[0] / 1e7, now[1] / 1e7, now[2], max(0.0, now[3] / 100), now[4] % 360
        if last is not None and metres_between(*last[:2], lat, lon) <= JUMP_M:
            share = lambda tau: 1 - math.exp(-dt / tau) if dt > 0 and tau > 0 else 1.0
            lat, lon = last[0] + (lat - last[0]) * share(tau_s), last[1] + (lon - last[1]) * share(tau_s)
            turn = (heading - last[3]) % 360
            speed, heading = last[2] + (speed - last[2]) * share(speed_tau_s), (last[3] + (turn - 360 if turn > 180 else turn) * share(heading_tau_s)) % 360
        return (lat, lon, speed, heading), (lat, lon, speed, heading)

    return folded(track, step, ["lat_e7", "lon_e7", "dt_s", "speed_cms", "heading_deg"], "lat double, lon double, speed_mps double, heading_deg double")


def recorded(track: DataFrame, every_m: float = 10.0) -> DataFrame:
    """(trip, seq, total_m): the samples that a recording keeps: those at least `every_m` of way after the last kept one, or behind it."""

    def step(last, now):
        if last is None or now[0] < last or now[0] - last >= every_m:
            return now[0], (now[0],)
        return last, None

    return folded(cumulative(track), step, ["total_m"], "total_m double")


def state_events(samples: DataFrame, state: Column) -> DataFrame:
    """(trip, seq, state): the samples at which a state differs from the one before, the first sample's included."""
    order = _order("seq")
    rows = samples.select("trip", "seq", state.alias("state"))
    return rows.withColumn("before", F.lag("state").over(order)).filter(~F.col("state").eqNullSafe(F.col("before"))).drop("before")


def lost_signals(samples: DataFrame, timeout_s: float = 5.0) -> DataFrame:
    """(trip, seq, lost_at_s, silent_s): the samples after which nothing came for longer than the timeout; samples (trip, seq, at_s)."""
    gap = F.lead("at_s").over(_order("seq")) - F.col("at_s")
    return samples.withColumn("silent_s", gap).filter(F.col("silent_s") > timeout_s).select("trip", "seq", (F.col("at_s") + timeout_s).alias("lost_at_s"), "silent_s")


def segments_at(places: DataFrame, way: DataFrame) -> DataFrame:
    """(trip, place_m, point, rest_m): for places (trip, place_m) along a way (trip, point, total_m) the segment that holds each, and how far into it: an as-of join by union and window."""
    left = places.select("trip", F.col("place_m").alias("m"), F.lit(1).alias("asks"), F.lit(None).cast("struct<point: int, m: double>").alias("mark"))
    right = way.select("trip", F.col("total_m").alias("m"), F.lit(0).alias("asks"), F.struct(F.col("point").cast("int").alias("point"), F.col("total_m").alias("m")).alias("mark"))
    order = Window.partitionBy("trip").orderBy("m", "asks", F.col("mark.point")).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("last", F.last("mark", ignorenulls=True).over(order))
    return both.filter("asks = 1 AND last IS NOT NULL").select("trip", F.col("m").alias("place_m"), "last.point", (F.col("m") - F.col("last.m")).alias("rest_m"))


def ridden_times(points: DataFrame) -> DataFrame:
    """Points of a recorded way (trip, seq, step_m, speed_kph) with time_s so far; speeds below 5 or unknown count as 50 km/h, those above 160 as 160."""
    v = F.col("speed_kph")
    kph = F.when(v.isNull() | F.isnan(v) | (v < 5), 50.0).otherwise(F.least(F.lit(160.0), v))
    return points.withColumn("time_s", F.sum(F.col("step_m") / (kph / 3.6)).over(_order("seq").rowsBetween(Window.unboundedPreceding, 0)))
