"""Rings around masks, chains of roads and triangles against plain walks."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import chains, polygons

STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))  # east, south, west, north


def plain_contours(cells):
    """Rings by walking: at each corner right, ahead or left; they begin at the least side."""
    sides = set()
    for x, y in cells:
        for x1, y1, d, (nx, ny) in ((x, y, 0, (x, y - 1)), (x + 1, y, 1, (x + 1, y)), (x + 1, y + 1, 2, (x, y + 1)), (x, y + 1, 3, (x - 1, y))):
            if (nx, ny) not in cells:
                sides.add((x1, y1, d))
    end = lambda s: (s[0] + STEPS[s[2]][0], s[1] + STEPS[s[2]][1])
    left, rings = set(sides), []
    while left:
        side = start = min(left, key=lambda s: (s[:2], end(s)))
        ring = []
        while side in left:
            left.remove(side)
            ring.append(side[:2])
            at = end(side)
            side = next(((*at, (side[2] + t) % 4) for t in (1, 0, 3, 2) if (*at, (side[2] + t) % 4) in sides), start)
        rings.append(ring)
    return rings


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def rings_of(frame):
    out = defaultdict(dict)
    for r in frame.collect():
        out[r.ring][r.place] = (r.x, r.y)
    return [[points[k] for k in range(len(points))] for points in out.values()]


@pytest.mark.parametrize(("seed", "share"), [(1, 0.5), (2, 0.75), (3, 0.3)])
def test_contours_equal_a_walk(spark, seed, share):
    rng = random.Random(seed)
    cells = {(x - 9, y - 9) for x in range(18) for y in range(18) if rng.random() < share} | {(40, 40), (41, 41), (50, 50)}
    frame = spark.createDataFrame(sorted(cells), "x long, y long")
    want = plain_contours(cells)
    corners = chains.contours(frame)
    assert sorted(rings_of(corners)) == sorted(want)
    areas = {r.ring: r.area for r in chains.contour_areas(corners).collect()}
    assert sorted(areas.values()) == sorted(map(area, want)) and (share < 0.5 or min(areas.values()) < 0)
    assert sorted(rings_of(chains.outlines(frame))) == sorted(r for r in want if area(r) >= 4)
    assert chains.contours(frame.limit(0)).count() == 0


def test_a_long_contour(spark):
    """A comb: one ring of some 4,000 sides."""
    cells = spark.range(500).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("id") % 2 == 0, 3).otherwise(0).cast("long"))).alias("y"))
    found = chains.contour_areas(chains.contours(cells)).collect()
    assert len(found) == 1 and found[0].area == cells.count()


def plain_chains(segments, by_kind):
    """segment -> (chain, place, reversed, total, closed) by walking from the ends, then around what is left."""
    ends = defaultdict(list)
    for s, (a, b, kind, _) in segments.items():
        ends[a, kind if by_kind else None].append((s, 0))
        ends[b, kind if by_kind else None].append((s, 1))

    def joined(s, side):
        a, b, kind, _ = segments[s]
        here = ends[(a, b)[side], kind if by_kind else None]
        if len(here) != 2 or len({segments[x][2] for x, _ in here}) > 1:
            return None
        return next(e for e in here if e != (s, side)) if here[0] != here[1] else here[1]

    done = {}

    def walk(s, side, closed):
        chain, place, total = s, 0, 0
        while s not in done:
            total += segments[s][3]
            done[s] = (chain, place, side == 1, total, closed)
            place += 1
            after = joined(s, 1 - side)
            if after is None:
                return
            s, side = after

    for s in sorted(segments):
        if s not in done and (joined(s, 0) is None or joined(s, 1) is None):
            walk(s, 0 if joined(s, 0) is None else 1, False)
    for s in sorted(segments):
        if s not in done:
            walk(s, 0, True)
    return done


@pytest.mark.parametrize("by_kind", [True, False])
def test_chains_of_roads_equal_a_walk(spark, by_kind):
    rng = random.Random(4)
    segments, n = {}, 0
    for _ in range(25):  # paths and rings that sometimes meet
        size, ring = rng.randint(1, 12), rng.random() < 0.3
        nodes = [rng.randrange(400) if rng.random() < 0.1 else 1000 + n + k for k in range(size + 1)]
        kind = rng.choice((None, 1, 2))
        for k in range(size):
            a, b = nodes[k], nodes[(k + 1) % size if ring else k + 1]
            segments[n * 7 % 1009] = (*((a, b) if rng.random() < 0.5 else (b, a)), kind if rng.random() < 0.9 else 3, rng.randint(0, 9))
            n += 1
        n += 50
    frame = spark.createDataFrame([(s, *v) for s, v in segments.items()], "segment long, a long, b long, kind int, length long")
    got = {r.segment: (r.chain, r.place, r.reversed, r.total, r.closed) for r in chains.chained(frame, by_kind).collect()}
    assert got == plain_chains(segments, by_kind)
    assert any(v[4] for v in got.values()) and max(v[1] for v in got.values()) > 5


def simple_ring(rng, n):
    """A star-shaped ring: corners by angle, at any distance."""
    turn = np.sort(rng.random(n)) * 2 * np.pi
    far = 0.1 + rng.random(n)
    return far * np.cos(turn), far * np.sin(turn)


def test_triangles_fill_their_ring_or_are_none(spark):
    rng = np.random.default_rng(6)
    rings = {k: simple_ring(rng, int(rng.integers(3, 40))) for k in range(60)}
    rings[60] = (np.array([0, 1, 0, 1.0]), np.array([0, 1, 1, 0.0]))  # crosses itself: no area
    rings[61] = (np.array([0, 4, 4, 0, 2.0, 2.0]), np.array([0, 0, 4, 4, -9, 9.0]))  # crosses itself
    rings[62] = (np.array([0, 1.0]), np.array([0, 1.0]))
    rings[63] = tuple(c[::-1] for c in simple_ring(rng, 30))  # the other way round
    frame = spark.createDataFrame([(k, x.tolist(), y.tolist()) for k, (x, y) in rings.items()] + [(64, None, None)], "ring_id long, xs array<double>, ys array<double>")
    found = defaultdict(list)
    for r in polygons.triangles(frame).collect():
        (x1, x2, x3), (y1, y2, y3) = r.xs, r.ys
        found[r.ring_id].append(((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2)
    whole = 0
    for k, (x, y) in rings.items():
        total = (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2
        if k in found and k != 61:  # what crosses itself has no inside to compare with
            whole += 1
            assert len(found[k]) == len(x) - 2 and sum(map(abs, found[k])) == pytest.approx(abs(total)) and len({t > 0 for t in found[k]}) == 1
    assert whole == 61 and not {60, 62, 64} & found.keys() and 63 in found


def test_mesh_covers_tiles(spark):
    """What tiles hold of a ring's triangles adds up to the ring, but for the widened edges."""
    rng = np.random.default_rng(7)
    x, y = simple_ring(rng, 24)
    ring = ((x * 0.2 + 0.5).tolist(), (y * 0.2 + 0.5).tolist())
    rows = polygons.mesh(spark.createDataFrame([(5, *ring)], "ring_id long, xs array<double>, ys array<double>"), 3, 0.0).collect()
    side = 1 / 65535 / 8
    total = sum(abs((r.x2 - r.x1) * (r.y3 - r.y1) - (r.x3 - r.x1) * (r.y2 - r.y1)) / 2 for r in rows) * side * side
    x, y = map(np.array, ring)
    assert total == pytest.approx(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2, rel=1e-3)
    assert len({(r.tile_x, r.tile_y) for r in rows}) > 4 and all(0 <= v <= 65535 for r in rows for v in (r.x1, r.y1, r.x2, r.y2, r.x3, r.y3))
