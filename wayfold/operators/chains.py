"""Linked lists as tables: rank every item of many chains at once; rings around masks and chains of roads are made of it.

Neighbours in a chain mostly have near numbers. So items are dealt out by ranges of their number, and a task joins
what follows each other inside its range into runs; only runs are ranked from then on, which are few. What is left
after that, once a task can hold it, is one range. Where numbers tell nothing of the neighbours and runs stay many, they are ranked by pointer
doubling: a round is one self-join in which every run learns what the one it points to knows, so
n runs take log2(n) rounds, and each has one row in each. A run is pointed to by at most one other, so no key of the join is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import tiles
from wayfold.session import stored, unstored

#: Items or runs that one task joins.
RANGE = 500_000
#: What a range makes of its runs: the first run of what each became part of, items and weights before it there, its own weight, and at heads the whole.
#: A run has n items and weights w; its least item with what comes before that in it, its last item, its last part, whether it is a ring, and behind what it comes.
_CHAIN = {k: "long" for k in ("outer", "n", "w", "low", "low_at", "low_w", "last", "tail")} | {"closed": "boolean"}
_ROWS = f"item long, head long, at long, so_far long, own long, chain struct<{', '.join(f'{k}: {v}' for k, v in _CHAIN.items())}>"


def ranked(links: DataFrame, most: int = RANGE) -> DataFrame:
    """(item, head, place, total, closed) of links (item, before, and weight if there is one): the first item of each item's chain, how many come before it, and the weights up to it.

    `before` is null at a chain's head; one that is no item itself counts as null. A closed chain
    begins at its least item. Items are unique, and no two have the same `before`. Without weights totals are 0.
    """
    return _ranked(links, most).drop("last")


def _ranked(links: DataFrame, most: int = RANGE) -> DataFrame:
    """As `ranked`, with the last item of the chain."""
    weight = F.col("weight") if "weight" in links.columns else F.lit(0).cast("long")
    links = stored(links.select("item", F.col("before").alias("ptr"), weight.alias("w")))
    found = _placed(links, most)
    unstored(links)
    at, so_far = F.col("at"), F.col("so_far")
    # A ring is ranked from wherever it was cut, and turned to its least item.
    place = F.when(F.col("closed"), F.pmod(at - F.col("low_at"), F.col("n"))).otherwise(at)
    total = so_far + F.col("own") + F.when(F.col("closed"), F.when(at < F.col("low_at"), F.col("w")).otherwise(0) - F.col("low_w")).otherwise(0)
    return found.select("item", F.when(F.col("closed"), F.col("low")).otherwise(F.col("head")).alias("head"), place.alias("place"), total.alias("total"), "closed", "last")


def _placed(runs: DataFrame, most: int) -> DataFrame:
    """(item, own, head, at, so_far, n, w, low, low_at, low_w, last, closed): of runs (item, ptr, n, w, low, low_at, low_w, last, closed), or items (item, ptr, w), their chain, the items and weights before them in it, their own weight, and the chain as a run.

    Runs are joined inside ranges of their numbers; only what leads out of a range is placed again, as longer runs.
    """
    size = runs.count()
    parts = -(-size // most)
    dealt = runs.repartitionByRange(parts, "item") if parts > 1 else runs.repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            yield from _as_rows(*_runs_joined(pa.Table.from_batches(held)))

    rows = stored(dealt.mapInArrow(run, _ROWS))
    heads = rows.filter("chain IS NOT NULL").select("head", "chain.*")
    whole = ["n", "w", "low", "low_at", "low_w", "last", "closed"]
    zero = F.lit(0).cast("long")
    of = lambda chains: chains.select(F.col("head").alias("run"), "head", zero.alias("run_at"), zero.alias("run_w"), *whole)
    out = heads.filter("outer IS NOT NULL").select("outer")
    if out.isEmpty():
        chains = of(heads)
    else:
        heads = stored(heads)
        behind, before = out.select(F.col("outer").alias("tail"), F.lit(True).alias("followed")), heads.select(F.col("tail").alias("outer"), F.col("head").alias("ptr"))
        # `before` of a chain is what ends where it points to; no two point to one.
        open_ = stored(heads.join(behind, "tail", "left").filter("outer IS NOT NULL OR followed").join(before, "outer", "left").select(F.col("head").alias("item"), "ptr", *whole))
        upper = _doubled(open_) if 2 * open_.count() > max(size, 2 * most) else _placed(open_, most)
        chains = of(heads.join(open_.select(F.col("item").alias("head")), "head", "left_anti")).unionByName(upper.select(F.col("item").alias("run"), "head", F.col("at").alias("run_at"), F.col("so_far").alias("run_w"), *whole))
    found = rows.select("item", "own", F.col("head").alias("run"), "at", "so_far").join(chains, "run")
    return found.select("item", "own", "head", (F.col("at") + F.col("run_at")).alias("at"), (F.col("so_far") + F.col("run_w")).alias("so_far"), *whole)


def _followed(before: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(open, first, sums before): of each row its chain's first row and the sums over all rows before it, by doubling in memory; open are the rows whose chain has no first."""
    ptr, first, out = before.copy(), np.arange(len(before)), [np.where(before >= 0, s[before], 0) for s in sums]
    work = np.flatnonzero(ptr >= 0)
    for _ in range(len(before).bit_length() + 1):
        to = ptr[work]
        first[work] = first[to]
        for s in out:
            s[work] += s[to]
        ptr[work] = ptr[to]
        work = work[ptr[work] >= 0]
        if not len(work):
            break
    return work, first, out


def _runs_joined(table: pa.Table) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(columns of rows, columns of chains, the rows of their heads, whether these point out of the range): what becomes of the runs of one range."""
    if "n" not in table.column_names:  # items, each a run of its own
        item, zero = table.column("item"), pa.array(np.zeros(len(table), np.int64))
        more = {"n": pa.array(np.ones(len(table), np.int64)), "low": item, "low_at": zero, "low_w": zero, "last": item, "closed": pa.array(np.zeros(len(table), bool))}
        table = pa.table(dict(zip(table.column_names, table.columns, strict=True)) | more)
    c = {name: table.column(name).fill_null(0).to_numpy() for name in table.column_names if name != "closed"}
    order = np.argsort(c["item"], kind="stable")
    c = {name: v[order] for name, v in c.items()}
    closed, points = table.column("closed").to_numpy()[order].astype(bool), table.column("ptr").is_valid().to_numpy()[order]
    item = c["item"]
    at = np.minimum(np.searchsorted(item, c["ptr"]), len(item) - 1)
    inside = points & (item[at] == c["ptr"])
    before = np.where(inside, at, -1)
    rings, first, sums = _followed(before, c["n"], c["w"])
    if len(rings):
        # Rings inside the range are cut before the run with their least item.
        least, ptr = c["low"].copy(), before.copy()
        for _ in range(len(rings).bit_length() + 1):
            least[rings] = np.minimum(least[rings], least[ptr[rings]])
            ptr[rings] = ptr[ptr[rings]]
        cut = rings[least[rings] == c["low"][rings]]
        before[cut], points[cut], closed[cut] = -1, False, True
        _, first, sums = _followed(before, c["n"], c["w"])
    # Of each run: its sums, its least item and its last row, which none of the range follows.
    by = np.argsort(first, kind="stable")
    head = np.flatnonzero(before < 0)
    begins = np.searchsorted(first[by], head)
    n, w = (np.add.reduceat(c[k][by], begins) for k in ("n", "w"))
    least = np.minimum.reduceat(c["low"][by], begins)
    whole = np.empty(len(item), np.int64)
    whole[head] = np.arange(len(head))
    low, tail = np.empty(len(head), np.int64), np.empty(len(head), np.int64)
    rows = np.flatnonzero(c["low"] == least[whole[first]])
    low[whole[first[rows]]] = rows
    followed = np.zeros(len(item), bool)
    followed[before[before >= 0]] = True
    rows = np.flatnonzero(~followed)
    tail[whole[first[rows]]] = rows
    out = {"item": item, "head": item[first], "at": sums[0], "so_far": sums[1], "own": c["w"]}
    chain = {"outer": c["ptr"][head], "n": n, "w": w, "low": least, "low_at": sums[0][low] + c["low_at"][low], "low_w": sums[1][low] + c["low_w"][low], "last": c["last"][tail], "tail": item[tail], "closed": closed[head]}
    return out, chain, head, points[head]


def _as_rows(out: dict[str, np.ndarray], chain: dict[str, np.ndarray], head: np.ndarray, points: np.ndarray, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """The columns as batches; what is told of a chain stands in its head's row."""
    arrays = [pa.array(chain["outer"], mask=~points), *(pa.array(chain[k]) for k in _CHAIN if k != "outer")]
    place = np.zeros(len(out["item"]), np.int64)
    place[head] = np.arange(len(head))
    is_head = np.zeros(len(place), bool)
    is_head[head] = True
    told = pa.StructArray.from_arrays(arrays, names=list(_CHAIN)).take(pa.array(place, mask=~is_head))
    columns = [*(pa.array(v) for v in out.values()), told]
    for k in range(0, len(place), size):
        yield pa.RecordBatch.from_arrays([v.slice(k, size) for v in columns], names=[*out, "chain"])


def _doubled(runs: DataFrame) -> DataFrame:
    """As `_placed`, by pointer doubling."""
    open_, done = _rounds(runs)
    ring = stored(open_.select("item", F.col("low").alias("least")))
    if not ring.isEmpty():
        # A ring is cut before the run with its least item and ranked as an open chain.
        cut = runs.join(ring, "item").withColumns({"ptr": F.when(F.col("low") != F.col("least"), F.col("ptr")), "closed": F.lit(True)})
        cut = stored(cut.select(*runs.columns))
        done = done.unionByName(_rounds(cut)[1])
        runs = runs.join(ring, "item", "left_anti").unionByName(cut)
    every = stored(done.join(runs.drop("ptr"), "item").withColumns({"at": F.col("upto") - F.col("n"), "so_far": F.col("upto_w") - F.col("w")}))
    low = F.min_by(F.struct("low", (F.col("at") + F.col("low_at")).alias("low_at"), (F.col("so_far") + F.col("low_w")).alias("low_w")), "low")
    chain = every.groupBy("head").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), low.alias("l"), F.max_by("last", "at").alias("last"), F.first("closed").alias("closed")).select("head", "n", "w", "l.*", "last", "closed")
    return every.select("item", "head", "at", "so_far", F.col("w").alias("own")).join(chain, "head")


def _rounds(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs of rings with the least item of each, (item, head, upto, upto_w) of all others: items and weights up to a run's end)."""
    state = stored(runs.select("item", "ptr", F.when(F.col("ptr").isNull(), F.col("item")).alias("head"), F.col("n").alias("upto"), F.col("w").alias("upto_w"), "low"))
    while True:
        there = state.select(F.col("item").alias("ptr"), F.col("ptr").alias("p"), F.col("head").alias("h"), F.col("upto").alias("d"), F.col("upto_w").alias("t"), F.col("low").alias("l"))
        on = state.filter("ptr IS NOT NULL").join(there, "ptr")
        news = (F.col("p").isNull() | (F.col("l") < F.col("low"))).alias("news")
        moved = on.select("item", F.col("p").alias("ptr"), F.col("h").alias("head"), (F.col("upto") + F.col("d")).alias("upto"), (F.col("upto_w") + F.col("t")).alias("upto_w"), F.least("low", "l").alias("low"), news)
        last, state = state, stored(state.filter("ptr IS NULL").withColumn("news", F.lit(False)).unionByName(moved))
        unstored(last)
        if state.filter("news").isEmpty():
            break
    return state.filter("ptr IS NOT NULL"), state.filter("ptr IS NULL").select("item", "head", "upto", "upto_w")


#: Directions of the sides of a mask, with what is set on the right hand: east, south, west, north.
_SIDES = {"N": (0, 0, 1, 0, 0), "E": (1, 0, 1, 1, 1), "S": (1, 1, 0, 1, 2), "W": (0, 1, 0, 0, 3)}


def contours(cells: DataFrame) -> DataFrame:
    """(ring, place, x, y): the corners, in order, of the rings around set cells (x, y), what is set on the right hand.

    Where four sides meet a ring turns right, so cells that only touch at a corner have rings of their own. A ring is named
    by its least side and begins there. Sides and their successors come from two joins, the order from ranking.
    """
    at = F.coalesce(*(F.when(F.col("side") == s, F.struct((F.col("x") + x1).alias("x1"), (F.col("y") + y1).alias("y1"), (F.col("x") + x2).alias("x2"), (F.col("y") + y2).alias("y2"), F.lit(d).alias("dir"))) for s, (x1, y1, x2, y2, d) in _SIDES.items()))
    sides = tiles.boundary(cells.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))).select(at.alias("e")).select("e.*")
    # Sides are ordered by where they begin, then by where they end: west, north, south, east.
    nth = F.element_at(F.array(*map(F.lit, (3, 2, 0, 1))), F.col("dir") + 1)
    item = (F.shiftleft(F.col("x1") + (1 << 29), 32) + F.shiftleft(F.col("y1") + (1 << 29), 2) + nth).alias("item")
    sides = stored(sides.select(item, "x1", "y1", "x2", "y2", "dir"))
    out = sides.select(F.col("item").alias("next"), F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("dir").alias("out"))
    turn = F.element_at(F.array(*map(F.lit, (1, 0, 3, 2))), F.pmod(F.col("out") - F.col("dir"), F.lit(4)) + 1)
    links = sides.join(out, ["x2", "y2"]).groupBy("item").agg(F.min_by("next", turn).alias("next"))
    order = ranked(links.select(F.col("next").alias("item"), F.col("item").alias("before")))
    return order.join(sides, "item").select(F.col("head").alias("ring"), "place", F.col("x1").alias("x"), F.col("y1").alias("y"))


def contour_areas(corners: DataFrame) -> DataFrame:
    """(ring, corners, area): the signed area of each ring in cells; holes are negative."""
    after = corners.select("ring", (F.col("place") - 1).alias("place"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    last = corners.groupBy("ring").agg(F.max("place").alias("place"))
    first = corners.filter("place = 0").join(last.withColumnRenamed("place", "end"), "ring").select("ring", F.col("end").alias("place"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    sides = corners.join(after.filter("place >= 0").unionByName(first), ["ring", "place"])
    return sides.groupBy("ring").agg(F.count("*").alias("corners"), (F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"))


def outlines(cells: DataFrame, least_cells: float = 4.0) -> DataFrame:
    """The corners of contours that enclose at least so many cells; holes are left out."""
    corners = stored(contours(cells))
    return corners.join(contour_areas(corners).filter(F.col("area") >= least_cells).select("ring"), "ring", "left_semi")


def chained(segments: DataFrame, by_kind: bool = True) -> DataFrame:
    """(segment, chain, place, reversed, total, closed) of segments (segment, a, b, kind, length): maximal chains through nodes where just two ends meet.

    Ends join if they are of one kind; with by_kind, a node's ends of other kinds don't count, without, they make it a
    junction. A chain begins at its end whose segment is least, a closed one at its least segment; `total` is
    the length up to a segment's far end, `reversed` tells whether it is passed from b to a.
    """
    segments = stored(segments.select("segment", "a", "b", "kind", "length"))
    ends = segments.select("segment", "kind", "length", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("node")), F.struct(F.lit(1).alias("side"), F.col("b").alias("node")))).alias("e")).select("segment", "kind", "length", "e.*")
    # A dart is a segment with a direction: it leaves from one end and arrives at the other.
    ends = ends.select("node", "kind", (F.col("segment") * 2 + F.col("side")).alias("leaves"), (F.col("segment") * 2 + 1 - F.col("side")).alias("arrives"), "length")
    at = ["node", "kind"] if by_kind else ["node"]
    dart = F.struct("kind", "leaves", "arrives", "length")
    here = stored(ends.groupBy(*at).agg(F.count("*").alias("n"), F.min(dart).alias("p"), F.max(dart).alias("q")))
    link = lambda one, before: F.struct(F.col(f"{one}.leaves").alias("item"), before.alias("before"), F.col(f"{one}.length").alias("weight"))
    head = F.lit(None).cast("long")
    through = F.expr("n = 2 AND p.kind <=> q.kind")
    links = here.select(F.explode(F.when(F.col("n") == 1, F.array(link("p", head))).when(through, F.array(link("p", F.col("q.arrives")), link("q", F.col("p.arrives"))))).alias("l")).select("l.*")
    hubs = here.filter((F.col("n") > 1) & ~through).select(*(F.col(c).alias(f"h_{c}") for c in at))
    if not hubs.isEmpty():
        same = [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in at]
        links = links.unionByName(ends.join(hubs, same, "left_semi").select(F.col("leaves").alias("item"), head.alias("before"), F.col("length").alias("weight")))
    order = _ranked(links)
    unstored(segments, here)
    # Each chain is there in both directions: the one whose head is less counts. The other begins where this one ends, a ring with its least segment's other dart.
    kept = order.filter(F.when(F.col("closed"), F.col("head") % 2 == 0).otherwise(F.col("head") < F.col("last").bitwiseXOR(F.lit(1))))
    return kept.select(F.expr("item div 2").alias("segment"), F.expr("head div 2").alias("chain"), "place", (F.col("item") % 2 == 1).alias("reversed"), "total", "closed")
