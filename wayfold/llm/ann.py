"""Approximate nearest neighbours by learned partitions.

Fit, on a bounded sample (`SAMPLE` vectors of least hash): the neighbour graph of the
sample is cut into balanced parts by repeated median cuts of its slowest diffusion mode;
a small neural network then learns, from a vector alone, which parts its graph
neighbours lie in. Index: every vector goes to its most probable part. Search: a query
goes to its `probes` most probable parts and is compared with all their vectors in
double precision; what falls short of its k-th best sample vector there is not emitted. `probes` is the least number whose recall on the sample is `GOAL`.

The number of parts grows with the table up to what the sample can teach. A part is cut
into blocks of about `BLOCK` vectors and its queries into blocks of as many, so a part or
a vector that a third of all rows share fills many groups of bounded size. Only the
sample, the network and one count per part pass the driver.

Cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, as queries or as candidates. Ties go to the smaller
id. With fewer candidates than `k` all are returned; an empty table gives no rows.
Repeated ids are rows of their own (none of them is its own candidate). Extra columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.frames import saved

SAMPLE, GOAL, BLOCK, PER_PART, NEIGHBOURS = 8192, 0.94, 16384, 1024, 10
#: Sample vectors that a part needs at least.
TAUGHT = 16


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the k others of largest inner product."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        score = x[at : at + 1024] @ x.T
        score[np.arange(len(score)), np.arange(at, at + len(score))] = -np.inf
        out[at : at + 1024] = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, parts: int, seed: int = 3, steps: int = 60) -> np.ndarray:
    """Part numbers below `parts` (a power of two), equally many nodes in each but for rounding."""
    n = len(near)
    rng = np.random.default_rng(seed)
    part = np.zeros(n, np.int64)
    while part.max(initial=0) + 1 < parts and n >= 2 * (part.max() + 1):
        inside = part[near] == part[:, None]
        degree = np.maximum(inside.sum(1), 1)
        mode = rng.standard_normal(n)
        for _ in range(steps):
            mode = 0.5 * mode + 0.5 * (mode[near] * inside).sum(1) / degree
            size = np.bincount(part)
            mode -= (np.bincount(part, mode) / size)[part]
            mode /= np.sqrt(np.bincount(part, mode**2) / size + 1e-30)[part]
        order = np.lexsort((mode, part))
        start = np.searchsorted(part[order], part[order])
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - start
        part = 2 * part + (rank >= (np.bincount(part)[part] + 1) // 2)
    return part


@dataclass
class Router:
    """A network of one hidden layer: the probabilities of a vector's parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def best(self, x: np.ndarray, m: int) -> np.ndarray:
        """The m most probable parts of each row, the best first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :m]


def fit_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 25, seed: int = 5) -> Router:
    """Softmax regression on soft labels by Adam."""
    rng = np.random.default_rng(seed)
    dim, parts = x.shape[1], target.shape[1]
    scale = 1 / max(1e-12, float(np.sqrt((x**2).mean())))
    params = [rng.standard_normal((dim, hidden)) * np.sqrt(2 / dim) * scale, np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            pick = order[at : at + 256]
            h = np.maximum(x[pick] @ params[0] + params[1], 0)
            z = h @ params[2] + params[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            dz = (p - target[pick]) / len(pick)
            dh = (dz @ params[2].T) * (h > 0)
            slopes = [x[pick].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)]
            t += 1
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                step = (scale if k == 0 else 1.0) * 3e-3
                params[k] -= step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Router(*params)


def fit(x: np.ndarray, rows: int, k: int = 20) -> Router:
    """The router for a table of so many rows, from a sample of its vectors."""
    parts = 1
    while (parts < 4 or rows > parts * 2 * PER_PART) and len(x) >= parts * 2 * TAUGHT:
        parts *= 2
    if len(x) <= NEIGHBOURS or parts == 1:
        dim = x.shape[1] if len(x) else 1
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    near = neighbours(x, NEIGHBOURS)
    part = balanced_parts(near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), part), 2.0)
    np.add.at(target, (np.repeat(np.arange(len(x)), NEIGHBOURS), part[near].ravel()), 1.0)
    router = fit_router(x, target / target.sum(1, keepdims=True))
    some = np.linspace(0, len(x) - 1, min(len(x), 1000)).astype(np.int64)
    score = x[some] @ x.T
    score[np.arange(len(some)), some] = -np.inf
    top = np.argpartition(-score, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
    home = router.best(x, 1)[:, 0]
    order = router.best(x[some], parts)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(some), 0), 1)
    needed = np.take_along_axis(rank, home[top], 1)
    share = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
    router.probes = int(np.searchsorted(share, GOAL) + 1)
    router.probes = min(router.probes, parts)
    return router


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows whose vectors take part, as packed doubles."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(fine)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = sizes[0].n if sizes else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], names=["vec_id", "v"])

    return rows.filter(F.size("v") == dim).mapInArrow(pack, "vec_id long, v binary")


def _stack(packed) -> np.ndarray:
    packed = list(packed)
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)


def nearest_in_block(queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, vec_id, score) of each query's k nearest of a block, as far as they reach its bound; a score does not depend on a row's place."""
    out_q, out_v, out_s = [], [], []
    for at in range(0, len(queries), 256):
        score = queries[at : at + 256] @ block.T
        for r in range(len(score)):
            row, q = score[r], query_ids[at + r]
            row[ids == q] = -np.inf
            least = bounds[at + r]
            if len(row) > k:
                least = max(least, row[np.argpartition(-row, k - 1)[k - 1]])
            pick = np.flatnonzero(row >= least - 1e-9 * max(1.0, abs(least))) if np.isfinite(least) else np.arange(len(row))
            pick = pick[ids[pick] != q]
            exact = (block[pick] * queries[at + r]).sum(1)
            best = np.lexsort((ids[pick], -exact))[:k]
            out_q.append(np.full(len(best), at + r))
            out_v.append(ids[pick][best])
            out_s.append(exact[best])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows of `queries` (ids of `vectors`) the k nearest found."""
    context = vectors.sparkSession.sparkContext
    rows = usable(vectors, id_col, vector_col)
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    known = _stack([bytes(r.v) for r in sample]) if sample else np.zeros((0, 1))
    fitted = fit(known, total, k)
    probes = fitted.probes
    router = context.broadcast(fitted)
    held_out = context.broadcast((known, np.array([r.vec_id for r in sample], np.int64), fitted.best(known, 1)[:, 0]))

    def route(m: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    best = router.value.best(_stack(batch.column(1).to_pylist()), m)
                    many = pa.array(np.repeat(np.arange(len(best)), best.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(best.ravel().astype(np.int32)), batch.column(0).take(many), batch.column(1).take(many)], names=["part", "vec_id", "v"])

        return run

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a query's k-th nearest scores at least: the k-th best of the sample within its parts."""
        for batch in route(probes)(batches):
            x, ids, home = held_out.value
            q_ids, parts = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            q = _stack(batch.column(2).to_pylist())
            bound = np.full(len(q), -np.inf)
            for at in range(0, len(q), probes):  # a query's rows follow each other
                score = x @ q[at]
                score[(ids == q_ids[at]) | ~np.isin(home, parts[at : at + probes])] = -np.inf
                if len(score) > k:
                    bound[at : at + probes] = np.partition(score, -k)[-k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound)], names=["part", "vec_id", "v", "bound"])

    shape = "part int, vec_id long, v binary"
    index = saved(rows.mapInArrow(route(1), shape))
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id")).distinct()
    # Rows of one id and different vectors are queries of their own; equal rows are asked once and answered as often.
    wanted_rows = saved(rows.join(asked, "vec_id", "left_semi").groupBy("vec_id", "v").agg(F.count("*").alias("times")))
    routed = saved(wanted_rows.select("vec_id", "v").mapInArrow(reach, shape + ", bound double").withColumn("q", F.xxhash64("v")))
    # One count per part: blocks of bounded size on either side.
    held = {r.part: -(-r["count"] // BLOCK) for r in index.groupBy("part").count().collect()}
    wanted = {r.part: -(-r["count"] // BLOCK) for r in routed.groupBy("part").count().collect()}
    if not held or not wanted:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def counts(of: dict[int, int]):
        return F.coalesce(F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[F.col("part")], F.lit(1))

    def dealt(frame: DataFrame, own: dict[int, int], other: dict[int, int], mine: str, theirs: str) -> DataFrame:
        return frame.withColumn(mine, F.pmod(F.xxhash64("vec_id"), counts(own)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), counts(other).cast("int") - 1)))

    left = dealt(routed, wanted, held, "q_block", "v_block")
    right = dealt(index, held, wanted, "v_block", "q_block")
    group = ["part", "q_block", "v_block"]

    def compare(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({n: pd.Series([], dtype="float64" if n == "score" else "int64") for n in ("query_id", "q", "vec_id", "score")})
        place, near, score = nearest_in_block(_stack(q["v"]), q["vec_id"].to_numpy(), q["bound"].to_numpy(), _stack(x["v"]), x["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": q["vec_id"].to_numpy()[place], "q": q["q"].to_numpy()[place], "vec_id": near, "score": score})

    found = left.groupBy(group).cogroup(right.groupBy(group)).applyInPandas(compare, "query_id long, q long, vec_id long, score double")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    again = wanted_rows.filter("times > 1").select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("q"), "times")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long"))))
    return best.join(again, ["query_id", "q"], "left").withColumn("__copy", copies).select("query_id", "rank", "vec_id", "score")
