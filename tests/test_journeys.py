"""Guidance, labels, missed turns and kept tables against plain loops."""

import math
import random

import pytest

from wayfold.operators import guide, labels, missed, packages
from wayfold.sources import folders

R = 6371008.8


def metres(a, b, c, d):
    q = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * R * math.atan2(math.sqrt(q), math.sqrt(max(0.0, 1 - q)))


def bearing(a, b, c, d):
    k = math.radians(d - b)
    y = math.sin(k) * math.cos(math.radians(c))
    x = math.cos(math.radians(a)) * math.sin(math.radians(c)) - math.sin(math.radians(a)) * math.cos(math.radians(c)) * math.cos(k)
    return math.degrees(math.atan2(y, x)) % 360


def turn(p, q, r):
    t = (bearing(*q, *r) - bearing(*p, *q)) % 360
    return t - 360 if t > 180 else t


def name(t):
    size, side = abs(t), "LEFT" if t < 0 else "RIGHT"
    return "CONTINUE" if size < 25 else f"SLIGHT_{side}" if size < 55 else side if size < 120 else f"SHARP_{side}" if size < 165 else "UTURN"


# Labels -------------------------------------------------------------------------------------------


def smooth(z, a, b):
    t = min(1.0, max(0.0, (z - a) / (b - a)))
    return t * t * (3 - 2 * t)


def one_after_the_other(view, rows):
    """The sequential rule for one view."""
    _, zoom, lat, lon, bear, w, h = view
    world = lambda la, lo: (((lo + 180) / 360) % 1, 0.5 - math.asinh(math.tan(math.radians(la))) / (2 * math.pi))
    cx, cy = world(lat, lon)
    px, a = 256 * 2**zoom, math.radians(bear)
    ordered = sorted((r for r in rows if r[1]), key=lambda r: (r[3], -r[4], r[0]))
    refs = {r[0] for r in sorted((r for r in ordered if r[2] <= 3), key=lambda r: r[2])[:3]}
    room = next(n for below, n in labels.ROOM if zoom < below)
    boxes, out = [], []
    for i, text, kind, lod, _, la, lo in ordered:
        if len(out) == room:
            break
        fade = smooth(zoom, *labels.LOD_ZOOM[lod])
        if i in refs:
            fade = max(fade, smooth(zoom, 6.0, 6.55))
        elif zoom < labels.KIND_ZOOM.get(kind, 14.0):
            continue
        x, y = world(la / 1e7, lo / 1e7)
        dx = x - cx
        dx = (dx - 1 if dx > 0.5 else dx + 1 if dx < -0.5 else dx) * px
        dy = (y - cy) * px
        sx, sy = w / 2 + dx * math.cos(a) + dy * math.sin(a), h / 2 - dx * math.sin(a) + dy * math.cos(a)
        if fade <= 0.001 or not (-100 <= sx <= w + 100 and -40 <= sy <= h + 40):
            continue
        half = len(text.encode()) * 4 + 4
        box = (sx - half, sy - 7, sx + half, sy + 10)
        if all(not (box[0] < b[2] and box[2] > b[0] and box[1] < b[3] and box[3] > b[1]) for b in boxes):
            boxes.append(box)
            out.append(i)
    return out


def test_labels_equal_the_sequential_rule(spark):
    """Crowded and empty views, either side of 180 degrees, turned, whole worlds, names of any length and none."""
    rng = random.Random(5)
    spots = [(48.0, 2.0), (10.0, 179.98), (-20.0, -179.99)]
    rows = []
    for i in range(900):
        la, lo = spots[i % 3]
        lo = (lo + rng.gauss(0, 0.05) + 180) % 360 - 180
        kind = rng.randint(1, 7)
        rows.append((i, rng.choice(["", "A", "Évry", "Saint-Martin-de-la-Place-les-Bains", "Bourg"]), kind, {1: 1, 2: 2, 3: 3, 5: 3}.get(kind, 4), rng.randint(0, 5), round((la + rng.gauss(0, 0.05)) * 1e7), round(lo * 1e7)))
    views = [(k, z, *spots[k % 3], b, 600, 900) for k, (z, b) in enumerate([(0.5, 0.0), (6.3, 45.0), (7.9, 0.0), (9.9, 300.0), (11.0, 90.0), (12.2, 10.0), (13.2, 181.0), (13.9, 0.0), (14.5, 77.0), (16.5, 5.0), (23.0, 0.0)])]
    views += [(90, 13.0, 0.0, 90.0, 0.0, 600, 900), (91, 13.0, 48.0, 2.0, 0.0, 0, 900)]  # nothing there, no screen
    got: dict = {}
    found = labels.placed(spark.createDataFrame(views, "view long, zoom double, lat double, lon double, bearing double, width int, height int"), spark.createDataFrame(rows, "label_id long, name string, kind int, lod int, rank int, lat_e7 long, lon_e7 long"))
    for r in sorted(found.collect(), key=lambda r: (r.view, r.nth)):
        got.setdefault(r.view, []).append(r.label_id)
    assert got == {v[0]: want for v in views if v[5] > 0 and (want := one_after_the_other(v, rows))}
    assert max(map(len, got.values())) >= 20


def test_no_labels(spark):
    none = spark.createDataFrame([], "label_id long, name string, kind int, lod int, rank int, lat_e7 long, lon_e7 long")
    views = spark.createDataFrame([(1, 13.0, 0.0, 0.0, 0.0, 100, 100)], "view long, zoom double, lat double, lon double, bearing double, width int, height int")
    assert labels.placed(views, none).count() == 0


# Instructions ---------------------------------------------------------------------------------------


def told(points, flags, route_m):
    """The rules of instructions, step by step. flags: None or (alternative, exit, into, out) of each point."""
    n = len(points)
    at = [0.0]
    for p, q in zip(points, points[1:], strict=False):
        at.append(at[-1] + metres(*p, *q))
    if not at[-1] > 0:
        return []
    scale = route_m / at[-1] if route_m and route_m > 0 else 1.0
    ring = lambda i: flags is not None and (flags[i][2] or flags[i][3])
    rows = [["DEPART", 0, 0.0, 0, 0.0, 0.0]]
    for i in range(1, n - 1):
        t, kind, exit_no, done = turn(points[i - 1], points[i], points[i + 1]), None, 0, at[i]
        if ring(i):
            if flags[i][3] and not flags[i][2]:
                kind, g = "ROUNDABOUT", i + 1
                while g < n and flags[g][2]:
                    done = at[g]
                    if g < n - 1 and (not flags[g][3] or flags[g][1]):
                        exit_no += 1
                    if not flags[g][3]:
                        break
                    g += 1
        elif abs(t) >= 25:
            if name(t) == "UTURN" or (abs(t) >= 45 if flags is None else flags[i][0]):
                kind = name(t)
        elif flags is not None and flags[i][0]:
            kind = "CONTINUE"
        if kind is None:
            continue
        if flags is not None and kind not in ("ROUNDABOUT", "CONTINUE", "UTURN"):
            a, way = i, 0.0
            while a > 0 and way < 30 and not ring(a - 1):
                way += metres(*points[a], *points[a - 1])
                a -= 1
            b, way = i, 0.0
            while b < n - 1 and way < 30 and not ring(b + 1):
                way += metres(*points[b], *points[b + 1])
                b += 1
            if a < i < b:
                t = turn(points[a], points[i], points[b])
                kind = name(t)
        rows.append([kind, i, t, exit_no, at[i] * scale, done * scale])
    rows.append(["ARRIVE", n - 1, 0.0, 0, at[-1] * scale, at[-1] * scale])
    thin = []
    for r in rows:
        if r[0] == "CONTINUE" and thin:
            gap = r[4] - thin[-1][4]
            if thin[-1][0] == "ROUNDABOUT" and gap <= 120:
                continue
            if thin[-1][0] == "CONTINUE" and gap <= 300:
                thin[-1] = r
                continue
        thin.append(r)
    for r, after in zip(thin, thin[1:] + [None], strict=True):
        gap = after[4] - r[5] if after else None
        r.append(0.0 if r[0] == "ARRIVE" else 5.0 if gap is None or gap < 0 or gap > 100 else 2.5 if gap <= 50 else 3.5)
    return thin


def test_instructions_equal_the_rules_step_by_step(spark):
    rng = random.Random(11)
    routes, lengths, want = [], [], {}
    for route in range(40):
        n = rng.choice([2, 3, 5, 12, 40])
        lat, lon, head, line = 48.0, 2.0, rng.uniform(0, 360), []
        for _ in range(n):
            line.append((lat, lon))
            head += rng.choice([0, 0, 5, -20, 30, -40, 60, 90, -90, 130, 175])
            step = rng.choice([4, 8, 15, 40, 120, 260])
            lat += step * math.cos(math.radians(head)) / 111195
            lon += step * math.sin(math.radians(head)) / 111195 / math.cos(math.radians(48))
        flags = None
        if route % 4:
            out = [rng.random() < 0.3 for _ in range(n - 1)] + [False]
            flags = [(rng.random() < 0.6, rng.random() < 0.5, k > 0 and out[k - 1], out[k]) for k in range(n)]
        length = rng.choice([None, 0.0, 1000.0])
        lengths.append((route, length))
        routes += [(route, k, *p, *(flags[k] if flags else (None,) * 4)) for k, p in enumerate(line)]
        want[route] = told(line, flags, length)
    routes += [(90, 0, 48.0, 2.0, *(None,) * 4), (91, 0, 48.0, 2.0, *(None,) * 4), (91, 1, 48.0, 2.0, *(None,) * 4)]  # one point, no way
    points = spark.createDataFrame(routes, "route long, pos int, lat double, lon double, alternative boolean, exit boolean, into_roundabout boolean, out_roundabout boolean")
    got: dict = {}
    for r in sorted(guide.instructions(points, spark.createDataFrame(lengths, "route long, route_m double")).collect(), key=lambda r: (r.route, r.nth)):
        got.setdefault(r.route, []).append(r)
    assert got.keys() == want.keys()
    for route, rows in want.items():
        assert [(r.kind, r.pos, r.exit_no, r.margin_m) for r in got[route]] == [(w[0], w[1], w[3], w[6]) for w in rows], route
        for r, w in zip(got[route], rows, strict=True):
            assert (r.turn, r.at_m, r.done_at_m) == pytest.approx((w[2], w[4], w[5]), abs=1e-4)
    kinds = {w[0] for rows in want.values() for w in rows}
    assert {"ROUNDABOUT", "CONTINUE", "UTURN", "LEFT"} <= kinds


@pytest.fixture(scope="module")
def town(spark):
    """A cross of streets (1 to 5, node 3 in its middle) and an island (8, 9)."""
    at = {1: (48.0, 2.0), 2: (48.0, 2.01), 3: (48.0, 2.02), 4: (48.01, 2.02), 5: (48.0, 2.03), 8: (48.2, 2.2), 9: (48.2, 2.21)}
    pairs = [(1, 2), (2, 3), (3, 4), (3, 5), (8, 9)]
    nodes = spark.createDataFrame([(k, *v) for k, v in at.items()], "node long, lat double, lon double")
    e7 = lambda k: [round(c * 1e7) for c in at[k]]
    located = spark.createDataFrame([(a, b, *e7(a), *e7(b)) for a, b in pairs], "a long, b long, a_lat long, a_lon long, b_lat long, b_lon long")
    both = pairs + [(b, a) for a, b in pairs]
    cm = lambda a, b: round(metres(*at[a], *at[b]) * 100)
    arcs = spark.createDataFrame([(a, b, cm(a, b), cm(a, b), cm(a, b)) for a, b in both], "src long, dst long, cost long, length_cm long, time_ms long")
    return nodes, located, arcs, spark.createDataFrame([(a, b, False) for a, b in both], "src long, dst long, roundabout boolean")


def test_requests_are_answered_or_say_why(spark, town):
    nodes, located, arcs, edges = town
    asked = [
        (1, 48.0001, 2.005, 48.009, 2.0201),  # along the street, then left at the cross
        (2, 48.5, 2.0, 48.0, 2.01), (3, 48.0, 2.01, 48.5, 2.0), (4, None, 2.0, 48.0, 2.0), (5, 48.0, 2.0, float("nan"), 2.0),
        (6, 48.0, 2.005, 48.2, 2.205), (7, 48.0, 2.002, 48.0, 2.008), (8, 48.0, 2.0, 48.0, 2.0),
    ]
    answers, said = guide.guided(spark.createDataFrame(asked, "request long, start_lat double, start_lon double, goal_lat double, goal_lon double"), located, arcs, edges, nodes)
    status = {r.request: r for r in answers.collect()}
    assert {k: r.status for k, r in status.items()} == {1: "OK", 2: "START_OFF_ROAD", 3: "GOAL_OFF_ROAD", 4: "START_OFF_ROAD", 5: "START_OFF_ROAD", 6: "NO_ROUTE", 7: "OK", 8: "OK"}
    kinds: dict = {}
    for r in sorted(said.collect(), key=lambda r: (r.route, r.nth)):
        kinds.setdefault(r.route, []).append((r.kind, r.pos))
    assert kinds == {1: [("DEPART", 0), ("LEFT", 2), ("ARRIVE", 3)], 7: [("DEPART", 0), ("ARRIVE", 1)]}
    assert status[1].start_snap_m == pytest.approx(11.1, abs=0.1) and status[8].length_cm == 0


# Missed turns ---------------------------------------------------------------------------------------


def off(p, line):
    per_lat = R * math.pi / 180
    per_lon, best = per_lat * math.cos(math.radians(p[0])), math.inf
    for a, b in zip(line, line[1:], strict=False):
        ax, ay, bx, by = (a[1] - p[1]) * per_lon, (a[0] - p[0]) * per_lat, (b[1] - p[1]) * per_lon, (b[0] - p[0]) * per_lat
        dx, dy = bx - ax, by - ay
        square = dx * dx + dy * dy
        t = min(1.0, max(0.0, -(ax * dx + ay * dy) / square)) if square > 1e-9 else 0.0
        best = min(best, math.hypot(ax + dx * t, ay + dy * t))
    return best


def first_branch(route, at, out, now):
    line, total = [at[n] for n in route], [0.0]
    for p, q in zip(line, line[1:], strict=False):
        total.append(total[-1] + metres(*p, *q))
    for k in range(1, len(route) - 1):
        if not now + 80 <= total[k] <= now + 2500:
            continue
        for first, _, _, ferry in out.get(route[k], []):
            if first in route or ferry:
                continue
            path, length, far = [route[k], first], 0.0, 0.0
            while True:
                length += metres(*at[path[-2]], *at[path[-1]])
                far = max(far, off(at[path[-1]], line))
                if (length >= 220 and far >= 80) or len(path) >= 32:
                    break
                choice = [(-(off(at[d], line) + cm / 100000), d, e) for d, e, cm, f in out.get(path[-1], []) if d not in path and d not in route and not f]
                if not choice:
                    break
                path.append(min(choice)[1])
            if length >= 120 and far >= 80:
                return k, path, length, far
    return None


def test_missed_turns_equal_plain_walks(spark):
    rng = random.Random(3)
    at = {k: (48 + k // 12 * 0.0007 + rng.uniform(0, 2e-4), 2 + k % 12 * 0.001 + rng.uniform(0, 2e-4)) for k in range(144)}
    arcs, no = [], 0
    for k in at:
        for d in (k + 1 if k % 12 < 11 else None, k + 12):
            if d in at and rng.random() < 0.75:
                for a, b in ((k, d), (d, k)):
                    arcs.append((no, a, b, round(metres(*at[a], *at[b]) * 100), rng.random() < 0.1))
                    no += 1
    out: dict = {}
    for e, a, b, cm, f in sorted(arcs, key=lambda r: (r[1], r[2], r[0])):
        out.setdefault(a, []).append((b, e, cm, f))
    routes = {r: [r * 12 + k for k in range(rng.randint(3, 12))] for r in range(12)} | {90: [1, 2]}
    riders = {r: rng.choice([0.0, 200.0, -5.0, None, 5000.0]) for r in routes}
    found = missed.planned(
        spark.createDataFrame([(r, k, n) for r, way in routes.items() for k, n in enumerate(way)], "route long, pos int, node long"),
        spark.createDataFrame(arcs, "edge_id long, src long, dst long, length_cm long, ferry boolean"),
        spark.createDataFrame([(k, *v) for k, v in at.items()], "node long, lat double, lon double"),
        spark.createDataFrame(list(riders.items()), "route long, at_m double"),
    ).collect()
    want = {r: w for r, way in routes.items() if len(way) > 2 and (w := first_branch(way, at, out, max(0.0, riders[r] or 0.0)))}
    assert {r.route: (r.pos, r.path) for r in found} == {r: w[:2] for r, w in want.items()}
    for r in found:
        assert (r.length_m, r.off_m) == pytest.approx(want[r.route][2:], abs=1e-6)
    assert 3 < len(want) < 12 and max(len(w[1]) for w in want.values()) > 3


# Kept tables ----------------------------------------------------------------------------------------

GRAPH = "node_id long, lat_e7 long, lon_e7 long", "src long, dst long, length_cm long, flags int, road_class int, max_speed_kph int"


def region(spark, name, moved=0):
    n = [(k, 480000000 + k * 10 + (moved if k == 5 else 0), 20000000) for k in range(10)]
    return name, spark.createDataFrame(n, GRAPH[0]), spark.createDataFrame([(k, (k + 1) % 10, 100, 0, 4, 50) for k in range(10)], GRAPH[1])


def test_gateways_are_kept_until_a_graph_changes(spark, tmp_path):
    folder = f"file://{tmp_path}/kept"
    a, b, c = region(spark, "a--b"), region(spark, "b"), region(spark, "c d")
    first, state = packages.cached_gateways(spark, folder, a, b)
    assert state == "built" and first.count() == 10
    again, state = packages.cached_gateways(spark, folder, b, a)
    assert state == "read" and sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    changed, state = packages.cached_gateways(spark, folder, a, region(spark, "b", moved=3))
    assert state == "built" and changed.count() == 9
    assert packages.cached_gateways(spark, folder, a, region(spark, "b", moved=3))[1] == "read"
    packages.cached_gateways(spark, folder, c, b)
    assert packages.boundary_candidates(spark, folder, a, c, (48.0, 2.0), (48.0, 2.0), 3).count() == 3
    assert len(folders.names(spark, folder)) == 3
    assert len(packages.forget_gateways(spark, folder, "b")) == 2 and len(folders.names(spark, folder)) == 1
    with pytest.raises(ValueError, match="itself"):
        packages.cached_gateways(spark, folder, a, a)


def test_a_kept_gateway_at_another_place_is_not_believed(spark, tmp_path):
    folder = f"file://{tmp_path}/kept"
    a, b = region(spark, "a"), region(spark, "b")
    rows = packages.cached_gateways(spark, folder, a, b)[0]
    wrong = [(r.left_node, r.right_node, r.lat_e7 + 1, r.lon_e7, r.penalty_m) for r in rows.collect()]
    pair = f"{folder}/a--b"
    kept = f"{pair}/{folders.names(spark, pair)[0]}"
    spark.createDataFrame(wrong, rows.schema).write.mode("overwrite").parquet(kept)
    rows, state = packages.cached_gateways(spark, folder, a, b)
    assert state == "built" and rows.filter("lat_e7 % 10 <> 0").isEmpty()


def test_gateways_without_a_cache(spark, tmp_path):
    (tmp_path / "file").write_text("not a folder")
    with pytest.warns(UserWarning, match="not kept"):
        rows, state = packages.cached_gateways(spark, f"file://{tmp_path}/file/kept", region(spark, "a"), region(spark, "b"))
    assert state == "computed" and rows.count() == 10


def test_signatures_know_every_value(spark):
    sign = lambda n, e: packages.graph_signature(n, e).collect()[0].signature
    _, nodes, edges = region(spark, "a")
    same = sign(nodes, edges)
    assert sign(nodes.repartition(7), edges.orderBy("dst")) == same
    assert sign(region(spark, "a", moved=1)[1], edges) != same
    assert sign(nodes, edges.unionByName(edges.limit(1))) != same
    assert sign(nodes, edges.withColumn("flags", edges.flags + 1)) != same
    assert sign(nodes.limit(0), edges.limit(0)) != same


def test_a_killed_preparation_resumes(spark, tmp_path):
    """A stage that fails, a table cut short, a manifest without a table: only what is missing and what follows is built."""
    folder, ran, broken = f"file://{tmp_path}/package", [], {"map"}

    def stage(name, before):
        def made(done):
            ran.append(name)
            if name in broken:
                raise RuntimeError("killed")
            return done[before].selectExpr("id + 1 AS id") if before else spark.range(20)

        return name, made

    stages = [stage("roads", None), stage("search", "roads"), stage("map", "roads"), stage("pyramid", "map")]
    run = lambda: {r.stage: (r.state, r.rows) for r in packages.prepared(spark, folder, stages).collect()}
    with pytest.raises(RuntimeError, match="killed"):
        run()
    assert ran == ["roads", "search", "map"] and folders.names(spark, folder) == ["roads", "roads.manifest", "search", "search.manifest"]
    broken.clear()
    ran.clear()
    assert run() == {"roads": ("kept", 20), "search": ("kept", 20), "map": ("built", 20), "pyramid": ("built", 20)} and ran == ["map", "pyramid"]
    ran.clear()
    assert {s for s, _ in run().values()} == {"kept"} and ran == []
    spark.range(3).write.mode("overwrite").parquet(f"{folder}/search")  # not what its manifest tells
    assert [s for s, _ in run().values()] == ["kept", "built", "built", "built"]
    folders.removed(spark, f"{folder}/pyramid.manifest")
    assert [s for s, _ in run().values()] == ["kept", "kept", "kept", "built"]


def test_new_roads_forget_gateways(spark, tmp_path):
    kept, folder = f"file://{tmp_path}/kept", f"file://{tmp_path}/package"
    packages.cached_gateways(spark, kept, region(spark, "a"), region(spark, "b"))
    stages = [("roads", lambda done: spark.range(2))]
    packages.prepared(spark, folder, stages, "a", kept)
    assert folders.names(spark, kept) == []
    packages.cached_gateways(spark, kept, region(spark, "a"), region(spark, "b"))
    packages.prepared(spark, folder, stages, "a", kept)
    assert len(folders.names(spark, kept)) == 1


# Search of all regions --------------------------------------------------------------------------------


def plain_search(places, listed, asked, limit, fold):
    """Region by region, then the list; each candidate against all taken before it."""
    match = lambda n: 0 if n == asked else 1 if n.startswith(asked) else 2 if asked in n else None
    hits = lambda rows: sorted((r for r in rows if fold[r[1]] and match(fold[r[1]]) is not None), key=lambda r: (match(fold[r[1]]), -r[3], len(r[1]), r[1].translate({c: c + 32 for c in range(65, 91)}), r[0], r[4], r[5]))[:limit]
    taken = []
    for region in [*sorted({r[6] for r in places}), None]:
        for r in hits([p for p in places if p[6] == region] if region else listed):
            lite = region is None
            same = lambda t: (t[0], t[4], t[5]) == (r[0], r[4], r[5]) or (t[4], t[5], t[1]) == (r[4], r[5], r[1]) or ((lite or t[7]) and t[6] == r[6] and fold[t[1]] == fold[r[1]])  # noqa: E731, B023
            if not any(same(t) for t in taken):
                taken.append((*r, lite))
    taken.sort(key=lambda t: (match(fold[t[1]]), -t[3], len(fold[t[1]]), t[1], t[7], t[6], t[0]))
    return [(*t, match(fold[t[1]])) for t in taken[:limit]]


def test_search_of_all_regions_equals_plain_loops(spark):
    from pyspark.sql import functions as F

    from wayfold.functions import text
    from wayfold.operators import search
    from wayfold.plans import journeys
    from wayfold.sources import regions

    places, listed = journeys._regional_places(spark, "/root/testdata/sf0.001"), regions.cities(spark)
    names = places.select("name").unionByName(listed.select("name")).distinct().select("name", text.normalized(F.col("name")).alias("n"))
    fold = {r.name: r.n or "" for r in names.collect()}
    rows, city = [tuple(r) for r in places.collect()], [tuple(r) for r in listed.collect()]
    seen = set()
    for asked in ("sa", "bourg", "le", "nan"):
        got = [tuple(r) for r in search.world(places, listed, f" {asked.upper()} ", 12).collect()]
        assert got == plain_search(rows, city, asked, 12, fold), asked
        seen |= {r[7] for r in got}
    assert seen == {True, False}
    assert search.world(places, listed, "s", 12).count() == 0
    # A chain: the second is the first by id, the third is the second by name; so the third stays.
    chain = spark.createDataFrame([(1, "Sab", 1, 9, 5, 5, "a"), (1, "Sac", 1, 8, 5, 5, "b"), (2, "Sac", 1, 7, 5, 5, "c")], places.schema)
    assert [(r.name, r.region) for r in search.world(chain, listed.limit(0), "sa").collect()] == [("Sab", "a"), ("Sac", "c")]


def test_damaged_indexes_are_left_out(spark, tmp_path):
    from wayfold.operators import search
    from wayfold.sources import geo_tables as g

    places = g.places(spark, "/root/testdata/sf0.001").limit(30)
    at = {name: f"{tmp_path}/{name}" for name in ("good", "cut", "torn", "none")}
    for name in ("good", "cut", "torn"):
        packages.prepared(spark, f"file://{at[name]}", [("search", lambda done: places.coalesce(1))])
    places.limit(3).write.mode("overwrite").parquet(f"file://{at['cut']}/search")
    torn = next((tmp_path / "torn" / "search").glob("*.parquet"))
    torn.write_bytes(b"PAR1 no more PAR1")
    (tmp_path / "torn" / "search" / f".{torn.name}.crc").unlink(missing_ok=True)
    rows, out = search.installed(spark, {k: f"file://{v}" for k, v in at.items()})
    assert sorted(out) == ["cut", "none", "torn"] and rows.count() == 30 and {r.region for r in rows.collect()} == {"good"}
