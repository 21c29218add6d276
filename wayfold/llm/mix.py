"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A document's words are cut into blocks. A source's target in words is a quota of its
blocks: whole epochs and a last part epoch, each an own pseudo-random permutation of the
source's blocks. The quotas of all sources are split between the output shards by a binary
tree: at each node the left half receives its exact number of blocks, drawn by the
multivariate hypergeometric law, and the right half the rest. A shard then draws, of each
source, the run of the permuted blocks that the tree gives it: what no run covers is not
taken, and no block of an epoch is taken twice. The block that meets the target is cut to
size. Within a shard, rows are put in the order of a hash.

Only numbers by source (and by source and shard) pass the driver: a documented bound
of `MAX_SOURCES` sources. Ranks and running sums within a source come from a histogram
over hash ranges, as many as the blocks need, and a window inside each range, so that a
source with a third of all rows is spread over all tasks.

Cases: a null text has size 0, and a document of size 0 gives nothing. Null is a
source, the last one. Repeated rows are copies with blocks of their own. Results depend
on doc_id, source and text only, so reruns agree. Columns beside these are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.frames import WORD, saved

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK_WORDS, PER_RANGE, SHARDS = 256, 100_000, 64
MAX_SOURCES = 1_000_000
KEY = ("doc_id", "source", "text_key", "copy")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take of each source: by weight, at most `most` times its size, the excess reshared."""
    weight = np.array([weights[k % len(weights)] for k in range(len(sizes))], float)
    size = np.array(sizes, float)
    out, open_, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), share * float(sum(sizes))
    while open_.any():
        part = left * weight / weight[open_].sum()
        over = open_ & (part > most * size)
        if not over.any():
            out[open_] = part[open_]
            break
        out[over] = most * size[over]
        left -= out[over].sum()
        open_ &= ~over
    return out.tolist()


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric; numpy's bound of 10^9 is passed by the normal law, whose error there is below 10^-4 of a deviation."""
    if n == 0 or good == 0 or bad == 0:
        return n if bad == 0 else 0
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mean, var = n * good / total, n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))
    return int(min(max(round(rng.normal(mean, var**0.5)), n - bad, 0), good, n))


def split(quotas: list[int], shards: int, seed: int = 7) -> list[list[int]]:
    """For each shard its exact number of blocks of each source."""
    out: list[list[int]] = []
    stack = [(list(quotas), shards, 1)]
    while stack:
        have, n, place = stack.pop()
        if n == 1:
            out.append(have)
            continue
        rng, left_shards = np.random.default_rng([seed, place]), n // 2
        total = sum(have)
        want, rest, left = total * left_shards // n, total, []
        for q in have:
            rest -= q
            got = _draw(rng, q, rest, want)
            left.append(got)
            want -= got
        stack.append(([q - g for q, g in zip(have, left, strict=True)], n - left_shards, 2 * place + 1))
        stack.append((left, left_shards, 2 * place))
    return out


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_key, copy, size): one row per document, in slim form."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    return slim.groupBy("doc_id", "source", "text_key", "size").agg(F.count("*").alias("n")).select("doc_id", "source", "text_key", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"), "size")


def plan(rows: DataFrame) -> DataFrame:
    """(source, source_no, source_size, target) of each source, null last."""
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    goal = targets([r.source_size for r in found])
    return spark.createDataFrame([(r.source, k, r.source_size, goal[k]) for k, r in enumerate(found)], "source string, source_no int, source_size long, target double")


def permuted(rows: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """All blocks of the epochs that the targets reach, with rank and words before in the permutation of source and epoch, and `wanted`: the words up to the target."""
    # Sources are a table that the driver made, at most `MAX_SOURCES` rows: small enough to send to every task.
    of = F.broadcast(sources.select(F.col("source").alias("s"), "source_no", F.floor(F.try_divide("target", "source_size")).cast("int").alias("whole"), F.col("source_size"), F.col("target")))
    bits = max(10, (int(rows.agg(F.sum(F.col("size") / block_words + 1)).collect()[0][0] or 0) // PER_RANGE).bit_length())
    cut = (
        rows.filter("size > 0")
        .join(of, F.col("source").eqNullSafe(F.col("s")))
        .select(*KEY, "source_no", "size", "whole", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long").alias("rest"))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
        .filter("epoch < whole OR rest > 0")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((size - 1) DIV {block_words} AS INT)"))))
        .withColumn("n_words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words))
        .withColumn("h", F.xxhash64("doc_id", "text_key", "copy", "block", "epoch", F.lit(seed)))
        .withColumn("range", F.shiftright("h", 64 - bits))  # ranges in the order of h, whatever their number
    )
    order = Window.partitionBy("source_no", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    histogram = cut.groupBy("source_no", "epoch", "range").agg(F.sum("n_words").alias("w"), F.count("*").alias("n"))
    before = histogram.select("source_no", "epoch", "range", F.coalesce(F.sum("w").over(order), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("n0"))
    within = Window.partitionBy("source_no", "epoch", "range").orderBy("h", "doc_id", "text_key", "copy", "block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("w0") + F.coalesce(F.sum("n_words").over(within), F.lit(0))
    return (
        cut.join(before, ["source_no", "epoch", "range"])
        .withColumns({"start": start, "rank": F.col("n0") + F.coalesce(F.count("*").over(within), F.lit(0))})
        .withColumn("wanted", F.when(F.col("epoch") < F.col("whole"), F.col("n_words")).otherwise(F.least("n_words", F.col("rest") - F.col("start"))))
        .select(*KEY, "source_no", "epoch", "block", "wanted", "rank", (F.col("block") * block_words).cast("long").alias("first_word"))
    )


def mix(docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(rows, taken): the documents in slim form with their source's size and target, and the blocks that the shards draw.

    taken has doc_id, source, text_key, copy, epoch, block, first_word, n_words, shard and place,
    by which the shard's rows are shuffled.
    """
    rows = saved(sized(docs))
    sources = plan(rows)
    every = saved(permuted(rows, sources, block_words, seed=seed))
    counts = every.groupBy("source_no", "epoch").agg(F.count("*").alias("n"), F.count_if(F.col("wanted") > 0).alias("quota")).collect()
    epochs = sorted((r.source_no, r.epoch, r.n, r.quota) for r in counts)
    numbers = sorted({e[0] for e in epochs})
    quota = dict.fromkeys(numbers, 0)
    offset = []  # a source's blocks run through its epochs; a shard owns a run of them
    for no, epoch, _, wanted in epochs:
        offset.append((no, epoch, quota[no]))
        quota[no] += wanted
    per_shard = split([quota[no] for no in numbers], shards, seed)
    runs = [(no, np.cumsum([q[k] for q in per_shard]).tolist()) for k, no in enumerate(numbers)]
    spark = docs.sparkSession
    offsets = F.broadcast(spark.createDataFrame(offset, "source_no int, epoch int, offset long"))
    ends = F.broadcast(spark.createDataFrame(runs, "source_no int, ends array<long>"))
    drawn = (
        every.join(offsets, ["source_no", "epoch"])
        .join(ends, "source_no")
        .withColumn("at", F.col("offset") + F.col("rank"))
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("at"))))
        .filter(F.col("shard") < shards)
        .withColumn("place", F.xxhash64("shard", "doc_id", "text_key", "copy", "epoch", "block", F.lit(seed)))
        .select(*KEY, "epoch", "block", "first_word", F.col("wanted").alias("n_words"), "shard", "place")
    )
    return rows.join(F.broadcast(sources.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s"), drawn


def taken_by_document(docs: DataFrame) -> DataFrame:
    """Each document's size, its source's size and target, the words and blocks that the shards draw of it, and which shards do."""
    rows, taken = mix(docs)
    by_shard = taken.groupBy(*KEY, "shard").agg(F.sum("n_words").alias("taken"), F.count("*").alias("n_blocks"))
    by_row = by_shard.groupBy(*KEY).agg(F.sum("taken").alias("taken"), F.sum("n_blocks").alias("n_blocks"), F.sort_array(F.collect_list("shard")).alias("shards"))
    left, right = rows.alias("l"), by_row.alias("r")
    same = F.lit(True)
    for c in KEY:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, same, "left").select(
        F.col("l.doc_id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.array_join(F.coalesce("shards", F.array().cast("array<int>")), ",").alias("shards")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the shards draw them: one row per document, epoch and shard, with the words of the shard's blocks.

    Rows come by shard, and within a shard in the order of `place`. Where a shard draws all of a
    document, the text stays as it is; of others, the words taken are joined by blanks, in
    their order. n_chars is the new text's; the columns are those of `docs`.
    """
    columns = docs.columns
    rows, taken = mix(docs)
    text_key = F.xxhash64("text").alias("text_key")
    draw = F.struct("shard", F.min("place").alias("place"), F.sum("n_words").alias("took"), F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("parts"))
    draws = taken.groupBy(*KEY, "epoch", "shard").agg(draw.alias("draw")).groupBy(*KEY).agg(F.collect_list("draw").alias("__draws"))
    draws = draws.select(*[F.col(c).alias(f"__{c}") for c in KEY], "__draws")
    keyed = docs.withColumn("__key", text_key)
    if rows.filter("copy > 1").isEmpty():  # no row repeats: texts need not be shuffled to be numbered
        numbered = keyed.withColumn("__no", F.lit(1))
    else:
        numbered = keyed.withColumn("__no", F.row_number().over(Window.partitionBy("doc_id", "source", "__key").orderBy(F.lit(0))))
    joined = numbered.join(
        draws,
        F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__key") == F.col("__text_key")) & (F.col("__no") == F.col("__copy")),
    )
    # A text meets its draws once and is cut into words once; then each draw takes its own.
    worded = joined.withColumn("__words", F.regexp_extract_all(F.col("text"), F.lit(WORD), 0)).select(*columns, "__words", F.explode("__draws").alias("__d"))
    pieces = F.expr("transform(__d.parts, p -> array_join(slice(__words, CAST(p.first_word AS INT) + 1, CAST(p.n_words AS INT)), ' '))")
    out = worded.withColumn("text", F.when(F.col("__d.took") == F.size("__words"), F.col("text")).otherwise(F.array_join(pieces, " ")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    # A shard may be large: its rows go to as many tasks as there are ranges of `place`.
    out = out.select(*columns, F.col("__d.shard").alias("__shard"), F.col("__d.place").alias("__place"))
    return out.repartition("__shard", F.shiftright("__place", 54)).sortWithinPartitions("__shard", "__place").select(*columns)
