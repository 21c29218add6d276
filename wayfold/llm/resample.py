"""Target-distribution importance resampling over bucket-partitioned inverted postings.

A text's features are its runs of 1 to `n` words; each falls into one of `BUCKETS` hash
buckets. A bucket's gain is the log-ratio of its smoothed shares in a target corpus
and in the documents; a document's weight is the floored mean gain of its features. Gumbel
noise that hangs on the id alone is added, and the highest scores are drawn.

Both corpora are counted by bucket first: one partial count per bucket and task, at most
`BUCKETS` rows in the end. Then the documents' postings (bucket, document, count) are
shuffled. They travel in blocks, one for each Arrow batch of documents and group of
buckets, and meet both corpora's counts of their buckets in a co-group, which computes
the gains and emits one contribution for each document it holds; these are summed
by document. Groups of buckets, rather than single ones, let a task add up what a document
has in many buckets, so at most `GROUPS` contributions leave for a document. Every group is
salted by batch: a bucket that all documents hold is dealt out like any other, and the number of
salts grows with the postings so that a co-group stays within `POSTINGS` on average.

Ranks come without a global sort in one task: scores are whole numbers of a bounded range
(logarithms of 64-bit counts and of 32-bit noise), so a table of counts by score, of at most some
200,000 rows at any size, gives each score its first rank; rows of one score are numbered among themselves.

Cases: a null or wordless text has no features, weight 0 and a score, and is not drawn
unless `least_words` is 0. Empty target or documents: gains follow the smoothed formula. A null
id counts as the empty text in the noise and comes first in ties. Repeated rows are
documents of their own; of rows with one id and text all get the same score and
successive ranks. Long texts are read whole. Columns beside the id and the text are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.frames import let_go, partitions, saved, text_batches

BUCKETS, GROUPS, POSTINGS = 10_000, 32, 1_000_000
#: Lower case for A-Z; digits, letters and all bytes beyond ASCII stay, what is left is a blank.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Places(dict):
    """The bucket of each feature met; forgets where it grows too large."""

    def __init__(self, buckets: int, keep: int = 400_000):
        super().__init__()
        self.buckets, self.keep = buckets, keep

    def __missing__(self, feature: bytes) -> int:
        if len(self) > self.keep:
            self.clear()
        self[feature] = place = zlib.crc32(feature) % self.buckets
        return place


def words_of(raw: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8."""
    return (raw or b"").translate(_TABLE).split()


def features_of(words: list[bytes], n: int = 1) -> list[bytes]:
    """All runs of 1 to n consecutive words."""
    runs = list(words)
    for k in range(2, n + 1):
        runs += map(b" ".join, zip(*(words[j:] for j in range(k)), strict=False))
    return runs


def _raw(frame: DataFrame, *more) -> DataFrame:
    return text_batches(frame).select(F.col("text").cast("binary").alias("text"), *more)


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, count, held): features of all texts by bucket, and the texts that hold any of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, count, held = _Places(buckets), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                runs = features_of(words_of(raw), n)
                own = np.bincount(np.fromiter(map(places.__getitem__, runs), np.int64, len(runs)), minlength=buckets)
                count += own
                held += own > 0
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(held[some])], names=["bucket", "count", "held"])
        let_go()

    part = _raw(texts).mapInArrow(run, "bucket int, count long, held long")
    return part.groupBy("bucket").agg(F.sum("count").alias("count"), F.sum("held").alias("held"))


_BLOCK = "grp int, salt int, bucket array<int>, doc array<int>, n array<int>, ids array<long>, tags array<int>, words array<int>"


def postings(docs: DataFrame, salts: int, n: int = 1, buckets: int = BUCKETS, groups: int = GROUPS) -> DataFrame:
    """Blocks of inverted postings: for a group of buckets the parallel arrays bucket, doc (a place in ids) and n.

    `words` holds the documents' word counts in the blocks of the first group, and is null elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(buckets)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            keys, words = [], np.zeros(rows, np.int32)
            for k, raw in enumerate(batch.column(0).to_pylist()):
                own = words_of(raw)
                words[k] = len(own)
                runs = features_of(own, n)
                keys.append(np.fromiter(map(places.__getitem__, runs), np.int64, len(runs)) * rows + k)
            key, times = np.unique(np.concatenate(keys), return_counts=True)
            bucket, doc = (key // rows).astype(np.int32), (key % rows).astype(np.int32)
            group = bucket % groups
            order = np.argsort(group, kind="stable")
            cuts = np.searchsorted(group[order], np.arange(groups + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x[order].astype(np.int32))) for x in (bucket, doc, times)]
            whole = lambda x: pa.ListArray.from_arrays(np.arange(groups + 1, dtype=np.int32) * rows, pa.concat_arrays([x] * groups))
            salt = zlib.crc32(f"{batch.column(1)[0]} {batch.column(2)[0]} {rows}".encode()) % salts
            block = [pa.array(np.arange(groups, dtype=np.int32)), pa.array(np.full(groups, salt, np.int32)), *lists, whole(batch.column(1)), whole(batch.column(2)), pa.array([words.tolist()] + [None] * (groups - 1), pa.list_(pa.int32()))]
            out = pa.RecordBatch.from_arrays(block, names=["grp", "salt", "bucket", "doc", "n", "ids", "tags", "words"])
            # A group without postings is left out; the first one carries the documents themselves.
            yield out.filter(pa.array((np.diff(cuts) > 0) | (np.arange(groups) == 0)))
        let_go()

    rows = _raw(docs, F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tag"))
    return rows.mapInArrow(run, _BLOCK)


_SHARE = "doc_id long, tag int, gain long, features long, words long, rows long"


def _contributions(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """One group of buckets: gains from both corpora's counts, and each document's sum of them."""
    gain = dict(zip(counts["bucket"].to_pylist(), _gains(counts), strict=True))
    found = []
    for at in range(blocks.num_rows):
        get = lambda name, at=at: blocks[name][at].values
        ids, tags, own = get("ids"), get("tags"), blocks["words"][at]
        bucket, doc, n = (get(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "doc", "n"))
        some, back = np.unique(bucket, return_inverse=True)
        gains = np.array([gain[b] for b in some.tolist()], np.int64)[back] if len(some) else np.zeros(0, np.int64)
        total, features = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        np.add.at(total, doc, gains * n)
        np.add.at(features, doc, n)
        first = own.is_valid
        words = own.values.to_numpy(zero_copy_only=False).astype(np.int64) if first else np.zeros(len(ids), np.int64)
        part = pa.table([ids, tags, total, features, words, np.full(len(ids), int(first))], schema=_SHARE_ARROW)
        found.append(part if first else part.filter(pa.array(features > 0)))
    if not found:
        return _SHARE_ARROW.empty_table()
    return pa.concat_tables(found).group_by(["doc_id", "tag"]).aggregate([(c, "sum") for c in ("gain", "features", "words", "rows")]).rename_columns(_SHARE_ARROW.names).cast(_SHARE_ARROW)


_SHARE_ARROW = pa.schema([("doc_id", pa.int64()), ("tag", pa.int32()), ("gain", pa.int64()), ("features", pa.int64()), ("words", pa.int64()), ("rows", pa.int64())])


def _gains(counts: pa.Table) -> list[int]:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each bucket, in doubles."""
    each = zip(*(counts[c].to_pylist() for c in ("s", "t", "all_s", "all_t", "buckets")), strict=True)
    return [math.floor(1000 * math.log((t + 1.0) * (big_s + m) / ((s + 1.0) * (big_t + m)))) for s, t, big_s, big_t, m in each]


def scored(docs: DataFrame, target: DataFrame, n: int = 1, seed: str = "2024", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of each document."""
    both = bucket_counts(docs, n, buckets).toDF("bucket", "s", "held").join(bucket_counts(target, n, buckets).select("bucket", F.col("count").alias("t")), "bucket", "full").fillna(0)
    both = saved(both)
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.coalesce(F.sum("held"), F.lit(0)).alias("held")).collect()[0]
    groups = min(GROUPS, buckets)
    salts = max(-(-4 * partitions(docs.sparkSession) // groups), -(-total.held // (groups * POSTINGS)))
    counts = both.select(F.pmod("bucket", F.lit(groups)).alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "bucket", "s", "t")
    counts = counts.withColumns({"all_s": F.lit(float(total.s)), "all_t": F.lit(float(total.t)), "buckets": F.lit(float(buckets))})
    shares = postings(docs, salts, n, buckets, groups).groupBy("grp", "salt").cogroup(counts.groupBy("grp", "salt")).applyInArrow(_contributions, _SHARE)
    sums = shares.groupBy("doc_id", "tag").agg(*(F.sum(c).alias(c) for c in ("gain", "features", "words", "rows")))
    # Equal rows (one id, one text) have been summed: the mean is that of each of them.
    each = sums.filter("rows > 0").select(
        "doc_id", F.expr("features div rows").alias("n_features"), F.expr("words div rows").alias("n_words"),
        F.expr("CASE WHEN features = 0 THEN 0L ELSE (gain - pmod(gain, features)) div features END").alias("weight"), F.explode(F.expr("sequence(1L, rows)")).alias("__copy"),
    )
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return each.select("doc_id", "n_features", "n_words", "weight", (F.col("weight") + noise).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, n: int = 1, seed: str = "2024", buckets: int = BUCKETS) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; rank is null where it isn't drawn."""
    rows = saved(scored(docs, target, n, seed, buckets))
    able = F.col("n_words") >= least_words
    draw = percent * rows.filter(able).count() // 100
    counts = rows.filter(able).groupBy("score").count().withColumn("span", F.floor(F.col("score") / 256))
    spans = counts.groupBy("span").agg(F.sum("count").alias("all"))
    above = spans.select("span", (F.sum("all").over(Window.orderBy(F.desc("span"))) - F.col("all")).alias("above"))  # a few hundred rows
    inside = F.sum("count").over(Window.partitionBy("span").orderBy(F.desc("score"))) - F.col("count")
    first = counts.withColumn("inside", inside).join(above, "span").select("score", (F.col("above") + F.col("inside")).alias("first")).filter(F.col("first") < draw)
    # `first` has at most a row for each whole score (see above), whatever the number of documents.
    placed = saved(rows.join(F.broadcast(first), "score", "left").withColumn("first", F.when(able, F.col("first"))))
    within = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features", "weight"))
    ranked = placed.filter("first IS NOT NULL").withColumn("rank", F.col("first") + within)
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, F.when(F.col("rank") <= draw, F.col("rank")).cast("long").alias("rank")).union(placed.filter("first IS NULL").select(*out, F.lit(None).cast("long")))
