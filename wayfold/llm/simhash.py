"""SimHash near-dedup by the generalised pigeonhole principle.

A fingerprint bit is set where over half of a text's shingle hashes have it. Fingerprints
link at `FAR` or fewer differing bits; equal ones are one class from the start, so everything
below works on distinct fingerprints.

The 64 bits are grouped into m partitions, correlated bits together (correlations are
those of all fingerprints). With thresholds t_i that sum to FAR - m + 1, two
linked fingerprints agree within t_i bits in at least one partition i; a threshold of
-1 leaves a partition out. For each m the thresholds are allotted by dynamic programming
over the estimated cost of each: rows that the partition's probes make, and candidate
pairs, which are estimated from the counts of equal values in all data and from
how often each bit differs. The cheapest m is taken: few values at small sizes, fewer and wider
partitions with probes of one flipped bit where a wide table would make long buckets.

Each fingerprint enters its own value in every partition used and probes all values within the
threshold. Buckets are verified in place by whole distances and only a spanning forest of
real links leaves them. A bucket beyond `BUCKET` rows is not compared: its keys are marked in
a bitmap of fixed size, and all fingerprints with a marked key go another, exact way. Each
is listed under the 64 fingerprints one bit away and under itself; two that differ in at
most two bits share one of these, and all that share one differ in at most two. Such a list holds at most 65.
So no bucket, however hot, is held by one task, and nothing is quadratic in it.

Cases: a null or wordless text has fingerprint zero, linked like any other. Fewer words
than a shingle count as one shingle. Repeated rows share a fingerprint. A null id makes no links and gets the
component of its fingerprint, null if no other row has it. Texts of any length are read whole.
Columns beside the id and the text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.frames import let_go, saved, text_batches
from wayfold.llm.jaccard import components

WORDS, FAR, SEED = 3, 2, 42
BUCKET, HOT_BITS, SPAN = 1024, 25, 1 << 16
#: A row that is shuffled costs as much as so many comparisons in a bucket.
ROW_COST = 200
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(raw: bytes | None, n: int = WORDS) -> int:
    """The fingerprint of a text in UTF-8."""
    words = (raw or b"").translate(_LOWER).split()
    if not words:
        return 0
    line, n = b" ".join(words), min(n, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n + 1]
    count, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), SPAN):
        a, b = starts[at : at + SPAN].tolist(), ends[n - 1 + at : n - 1 + at + SPAN].tolist()
        hashes = np.array([digest(line[i:j], SEED) for i, j in zip(a, b, strict=True)], "<u8")
        count += _bits(hashes).sum(0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * count > len(starts)).tolist())


def _bits(values: np.ndarray) -> np.ndarray:
    """A row of 64 bits for each value, the lowest first."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(docs: DataFrame, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each document, fp as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, n) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
        let_go()

    return text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy().view(np.uint64)


def correlations(distinct: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """How many fingerprints there are, the share of each bit, and the bits' absolute correlations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            x = _bits(_longs(batch, "fp")).astype(np.float32)
            both += x.T @ x
            n += len(x)
        i, j = np.divmod(np.arange(64 * 64), 64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, 64).astype(np.int32)), pa.array(np.append(j, 64).astype(np.int32)), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["i", "j", "c"])

    cells = distinct.select("fp").mapInArrow(run, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()  # 4,097 numbers
    both = np.zeros((65, 65))
    for r in cells:
        both[r.i, r.j] = r.c
    n = int(both[64, 64])
    share = both.diagonal()[:64] / max(n, 1)
    cov = both[:64, :64] / max(n, 1) - np.outer(share, share)
    scale = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    return n, share, np.abs(cov / np.outer(scale, scale))


def grouped(near: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of equal size, each grown from the bit that is closest to those left by what is closest to it."""
    left, groups = set(range(64)), []
    for k in range(m):
        size = -(-len(left) // (m - k))
        rest = sorted(left)
        group = [max(rest, key=lambda b: near[b, rest].sum())] if rest else []
        while len(group) < size:
            group.append(max(sorted(left - {*group}), key=lambda b: near[b, group].sum()))
        left -= {*group}
        groups.append(sorted(group))
    return groups


def values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The partition's bits of each fingerprint, packed."""
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def equal_pairs(distinct: DataFrame, plans: list[list[list[int]]]) -> dict[tuple[int, int], int]:
    """For each partition of each plan the number of ordered pairs that have the same value there, over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _longs(batch, "fp")
            for p, plan in enumerate(plans):
                for i, bits in enumerate(plan):
                    v, c = np.unique(values(fp, bits), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), p, np.int32)), pa.array(np.full(len(v), i, np.int32)), pa.array(v.view(np.int64)), pa.array(c)], names=["plan", "part", "value", "c"])

    counted = distinct.select("fp").mapInArrow(run, "plan int, part int, value long, c long").groupBy("plan", "part", "value").agg(F.sum("c").alias("c"))
    found = counted.groupBy("plan", "part").agg(F.sum(F.col("c").cast("decimal(19,0)") * F.col("c")).alias("s")).collect()  # a row for each partition
    return {(r.plan, r.part): int(r.s) for r in found}


def allotted(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """The thresholds of least cost that sum to `total`: cost[i][t + 1] is that of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        now: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, more in enumerate(row, -1):
                if s + t not in now or c + more < now[s + t][0]:
                    now[s + t] = (c + more, [*chosen, t])
        best = now
    return best[total]


def planned(distinct: DataFrame, far: int = FAR) -> list[tuple[list[int], int]]:
    """The partitions that are used, as (bits, threshold)."""
    n, share, near = correlations(distinct)
    differ = 2 * share * (1 - share)
    odds = differ / np.maximum(1 - differ, 1e-9)
    plans = [grouped(near, m) for m in range(1, far + 3)]
    same = equal_pairs(distinct, plans)
    choices = []
    for p, plan in enumerate(plans):
        cost = []
        for i, bits in enumerate(plan):
            ways = np.zeros(far + 1)  # sums of products of odds over so many differing bits
            ways[0] = 1
            for b in bits:
                ways[1:] += odds[b] * ways[:-1].copy()
            each = [0.0]
            for t in range(far + 1):
                rows = n * (1 + sum(comb(len(bits), k) for k in range(1, t + 1)))
                each.append(ROW_COST * rows + float(same.get((p, i), 0)) * float(ways[: t + 1].sum()))
            cost.append(each)
        total, chosen = allotted(cost, far - len(plan) + 1)
        choices.append((total, [(bits, t) for bits, t in zip(plan, chosen, strict=True) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


def probes(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, probe, fp, rep): each fingerprint's own value in each partition, and the values that it probes."""
    masks = [[np.uint64(sum(1 << k for k in flips)) for t in range(1, most + 1) for flips in combinations(range(len(bits)), t)] for bits, most in plan]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _longs(batch, "fp")
            for i, (bits, _) in enumerate(plan):
                own = values(fp, bits)
                for k, mask in enumerate([np.uint64(0), *masks[i]]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), pa.array((own ^ mask).view(np.int64)), pa.array(np.full(len(fp), k > 0)), batch.column(0), batch.column(1)], names=["part", "value", "probe", "fp", "rep"])

    return distinct.select("fp", "rep").mapInArrow(run, "part int, value long, probe boolean, fp long, rep long")


def _linked(fp: np.ndarray, own: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows of a bucket of which one at least is no probe."""
    close = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= far
    close &= own[:, None] | own[None, :]
    left, nodes, parents = np.ones(len(fp), bool), [], []
    while left.any():
        front = np.array([int(np.argmax(left))])
        left[front] = False
        while len(front):
            fresh = np.flatnonzero(close[front].any(0) & left)
            left[fresh] = False
            nodes.append(fresh)
            parents.append(front[close[np.ix_(front, fresh)].argmax(0)])
            front = fresh
    return np.concatenate(nodes), np.concatenate(parents)


def bucket_links(rows: DataFrame, far: int = FAR) -> DataFrame:
    """(a, b): links found in buckets of at most `BUCKET` rows, as a spanning forest of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def found(part: pa.Table) -> pa.RecordBatch:
            at, value, fp, rep = (part[c].to_numpy() for c in ("part", "value", "fp", "rep"))
            own = ~part["probe"].to_numpy()
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (value[1:] != value[:-1])) + 1).tolist(), len(at)]
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y - x > 1:
                    i, j = _linked(fp[x:y].view(np.uint64), own[x:y], far)
                    a.append(rep[x + i])
                    b.append(rep[x + j])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]).combine_chunks() if rest is not None and rest.num_rows else now
            # The last bucket may go on in the next batch.
            at, value = now["part"].to_numpy(), now["value"].to_numpy()
            cut = int(np.argmax((at == at[-1]) & (value == value[-1])))
            if cut:
                yield found(now.slice(0, cut))
            rest = now.slice(cut)
        if rest is not None and rest.num_rows:
            yield found(rest)

    return rows.repartition("part", "value").sortWithinPartitions("part", "value").mapInArrow(run, "a long, b long").filter("a <> b")


def shared_neighbours(hot: DataFrame) -> DataFrame:
    """(a, b): links between fingerprints (fp, rep) that differ in at most two bits, each to the least of a shared neighbour's list."""
    around = F.explode(F.expr("transform(sequence(-1, 63), k -> if(k < 0, fp, fp ^ shiftleft(1L, k)))"))
    listed = hot.select("rep", around.alias("z")).withColumn("least", F.min("rep").over(Window.partitionBy("z")))
    return listed.filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()


def links(distinct: DataFrame, far: int = FAR, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between the representatives of distinct fingerprints (fp, rep) that connect all that are within `far` bits."""
    if far != 2:
        raise ValueError("lists of shared neighbours decide distances of two bits")
    spark = distinct.sparkSession
    rows = probes(distinct, planned(distinct, far))
    key = F.pmod(F.xxhash64("part", "value"), F.lit(1 << HOT_BITS))
    sizes = rows.groupBy("part", "value").count().filter(F.col("count") > bucket)
    marks = sizes.select(key.alias("p")).groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("nth")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("bits")).collect()
    whole = np.zeros((1 << HOT_BITS) // 8, np.uint8)
    for r in marks:
        part = np.frombuffer(bytes(r.bits), np.uint8)
        whole[(r.nth - 1) * 4096 : (r.nth - 1) * 4096 + len(part)] = part
    if not whole.any():
        return bucket_links(rows, far)
    held = spark.sparkContext.broadcast(whole)

    def marked(want: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = batch.column("p").to_numpy()
                yield batch.filter(pa.array(((held.value[p >> 3] >> (p & 7)) & 1 == 1) == want))

        return run

    schema = "part int, value long, probe boolean, fp long, rep long, p long"
    keyed = rows.withColumn("p", key)
    hot = keyed.mapInArrow(marked(True), schema).select("fp", "rep").distinct()
    return bucket_links(keyed.mapInArrow(marked(False), schema).drop("p"), far).union(shared_neighbours(hot))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, far: int = FAR) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document."""
    prints = saved(fingerprints(docs, n, id_col, text_col))
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(classes.filter("rep IS NOT NULL"), far)).toDF("rep", "c")
    of = classes.join(found, "rep", "left").select("fp", F.coalesce("c", "rep").alias("component_id"))
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
