"""Chains ranked by ranges of their items, of any size, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import chains


@pytest.mark.parametrize(("near", "most"), [(True, 40), (False, 40), (True, 100_000)])
def test_ranges_of_any_size_rank_alike(spark, near, most, monkeypatch):
    """Neighbours with near numbers need no rounds; items at random are doubled; totals turn with their ring."""
    rng = random.Random(9)
    items = sorted(rng.sample(range(-9_000, 9_000), 600))
    if not near:
        rng.shuffle(items)
    before, at = {}, 0
    for size, ring in ((1, False), (1, True), (2, True), (150, False), (130, True), (64, True), (100, False), (152, True)):
        part = items[at : at + size]
        at += size
        turn = rng.randrange(size)
        part = part[turn:] + part[:turn] if ring else part
        for k, x in enumerate(part):
            before[x] = part[k - 1] if k or ring else None
    before[items[0]] = 99_999  # no item itself
    weight = {x: rng.randint(0, 9) for x in before}
    want = {}
    for x in before:
        seen, y = [x], before[x]
        while y in before and y not in seen:
            seen.append(y)
            y = before[y]
        closed = y in before
        k = seen.index(min(seen)) if closed else len(seen) - 1
        want[x] = (seen[k], k, sum(weight[z] for z in seen[: k + 1]), closed)
    doubled = []
    real = chains._doubled
    monkeypatch.setattr(chains, "_doubled", lambda runs: doubled.append(1) or real(runs))
    frame = spark.createDataFrame([(x, b, weight[x]) for x, b in before.items()], "item long, before long, weight long")
    got = {r.item: (r.head, r.place, r.total, r.closed) for r in chains.ranked(frame, most).collect()}
    assert got == want and bool(doubled) == (not near and most == 40)


def test_many_short_chains_are_done_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(chains, "_doubled", lambda _: pytest.fail("nothing leads out of a range"))
    links = spark.range(300).select(F.col("id").alias("item"), F.when(F.col("id") % 3 != 0, F.col("id") - 1).alias("before"))
    got = chains.ranked(links, 50)
    assert {(r.item, r.head, r.place, r.total) for r in got.collect()} == {(k, k - k % 3, k % 3, 0) for k in range(300)}
