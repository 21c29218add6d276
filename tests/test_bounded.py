"""The bounded search from both ends against plain relaxation, and chain ranking against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import bounded, chains, graph


def plain(arcs, starts, goals):
    """(total, goal, nodes from the start) by plain relaxation: the smallest goal, and from it always the smallest node before."""
    cost = dict(starts)
    changed = True
    while changed:
        changed = False
        for (a, b), c in arcs.items():
            if a in cost and (b not in cost or cost[a] + c < cost[b]):
                cost[b], changed = cost[a] + c, True
    ends = sorted((cost[n] + c, n) for n, c in goals.items() if n in cost)
    if not ends:
        return None
    total, node = ends[0]
    way = [node]
    while not (node in starts and starts[node] == cost[node]):
        node = min(a for (a, b), c in arcs.items() if b == node and a in cost and cost[a] + c == cost[node])
        way.append(node)
    return total, ends[0][1], way[::-1]


def random_graph(rng, n, lattice):
    spots = {k: (50 + rng.random(), 3 + rng.random()) for k in range(n)}
    arcs = {}
    for a in range(n):
        near = [a + 1, a - 1, a + 7, a - 7] if lattice else [rng.randrange(n) for _ in range(3)]
        for b in near:
            if 0 <= b < n and b != a and rng.random() < 0.85:
                metres = ((spots[a][0] - spots[b][0]) ** 2 + (spots[a][1] - spots[b][1]) ** 2) ** 0.5 * 100_000
                arcs[a, b] = round(metres * rng.choice((1, 1, 1.5))) if not lattice else rng.randint(1, 4)
    return spots, arcs


@pytest.mark.parametrize(("seed", "lattice", "window"), [(1, True, None), (2, False, None), (3, True, 1), (4, False, 10**9)])
def test_ways_equal_plain_relaxation(spark, seed, lattice, window):
    rng = random.Random(seed)
    n = 49 if lattice else 60
    spots, arcs = random_graph(rng, n, lattice)
    asked = {r: ({rng.randrange(n): rng.randint(0, 3) for _ in range(rng.randint(1, 2))}, {rng.randrange(n): rng.randint(0, 3) for _ in range(rng.randint(1, 2))}) for r in range(25)}
    frame = lambda side: spark.createDataFrame([(r, k, c) for r, both in asked.items() for k, c in both[side].items()], "request long, node long, cost long")
    table = spark.createDataFrame([(a, b, c) for (a, b), c in arcs.items()], "src long, dst long, cost long")
    places = spark.createDataFrame([(k, *p) for k, p in spots.items()], "node long, lat double, lon double")
    best, steps = bounded.between(table, frame(0), frame(1), places if seed % 2 == 0 else None, window)
    got = {r.request: (r.total, r.goal) for r in best.collect()}
    ways = {}
    for r in steps.collect():
        ways.setdefault(r.request, {})[r.hop] = r.node
    for r, (starts, goals) in asked.items():
        want = plain(arcs, starts, goals)
        assert (r in got) == (want is not None)
        if want:
            assert got[r] == want[:2] and [ways[r][k] for k in sorted(ways[r], reverse=True)] == want[2]


def test_a_search_stays_between_its_ends(spark):
    """On a long line a request for near ends labels little, and one without a way ends."""
    n = 400
    arcs = spark.range(n - 1).select(F.explode(F.array(F.struct(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), F.struct((F.col("id") + 1).alias("src"), F.col("id").alias("dst")))).alias("a")).select("a.src", "a.dst", F.lit(10).cast("long").alias("cost"))
    ends = lambda *nodes: spark.createDataFrame([(k, x, 0) for k, x in enumerate(nodes)], "request long, node long, cost long")
    places = spark.range(n).select(F.col("id").alias("node"), F.lit(50.0).alias("lat"), (F.col("id") / 1000).alias("lon"))
    labels, totals = bounded.labelled(arcs, ends(200, 10, 5), ends(208, 10, n + 5), places, 1000)
    assert {r.request: r.total for r in totals.collect()} == {0: 80, 1: 0}
    assert labels.filter("request = 0").count() <= 30 and labels.filter("request = 1").count() <= 3
    empty = ends().limit(0)
    assert bounded.between(arcs, empty, empty)[0].count() == 0


def test_chains_are_ranked(spark):
    rng = random.Random(5)
    items = rng.sample(range(10_000), 900)
    before, at = {}, 0
    for size, ring in ((1, False), (1, True), (2, True), (300, False), (257, True), (64, True), (100, False), (175, False)):
        part = items[at : at + size]
        at += size
        for k, x in enumerate(part):
            before[x] = part[k - 1] if k or ring else None
    before[items[0]] = 99_999  # no item itself
    want = {}
    for x in before:
        seen, y = [x], before[x]
        while y in before and y not in seen:
            seen.append(y)
            y = before[y]
        if y in before:  # a ring: from its least item on
            head = min(seen)
            want[x] = (head, seen.index(head), True)
        else:
            want[x] = (seen[-1], len(seen) - 1, False)
    got = chains.ranked(spark.createDataFrame(list(before.items()), "item long, before long"))
    assert {r.item: (r.head, r.place, r.closed) for r in got.collect()} == want
    assert chains.ranked(got.select("item", F.col("head").alias("before")).limit(0)).count() == 0


def test_ways_by_doubling(spark):
    found = spark.createDataFrame([(0, k, max(0, k - 1)) for k in range(40)] + [(1, 5, 5)], "origin long, node long, via long")
    steps = graph.ways(found, spark.createDataFrame([(0, 39), (0, 0), (0, 77), (1, 5)], "origin long, node long")).collect()
    ways = {}
    for r in steps:
        ways.setdefault((r.origin, r.target), {})[r.hop] = r.node
    assert ways == {(0, 39): {k: 39 - k for k in range(40)}, (0, 0): {0: 0}, (1, 5): {0: 5}}
    round_ = spark.createDataFrame([(0, 1, 2), (0, 2, 1)], "origin long, node long, via long")
    with pytest.raises(ValueError, match="circle"):
        graph.ways(round_, spark.createDataFrame([(0, 1)], "origin long, node long"))
