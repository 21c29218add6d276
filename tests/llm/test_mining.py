"""Resampling, collocations and SimHash against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_operators import odd, text_words  # noqa: F401  odd is a fixture
from wayfold.llm import colloc, queries, resample, simhash

SMALL = "/root/testdata/sf0.001"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def tables(spark, *names):
    return [spark.read.parquet(f"{SMALL}/{n}.parquet") for n in names]


# 11 -----------------------------------------------------------------------------------------------


def plain_resample(docs, target, percent=10, least=20, n=1, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) by direct counting."""

    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, words, f in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


def resampled(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_resample_equals_plain_counting(spark):
    docs, target = tables(spark, "documents", "benchmark")
    got = queries.op11_resample(spark, SMALL)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    want = plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert resampled(got) == want and sum(r[4] is not None for r in want) > 10


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10_000, 50), (2, 64, 100), (3, 7, 30)])
def test_resample_cases(spark, odd, n, buckets, percent):  # noqa: F811
    target = odd.filter("doc_id in (0, 4, 5, 12)")
    got = resample.resample(odd, target, percent, 4, n, buckets=buckets)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert resampled(got) == plain_resample(rows, [r.text for r in target.collect()], percent, 4, n, buckets)


def test_resample_ties_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b"), (3, "a b c"), (3, "a b c"), (3, "x y z"), (4, None)], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for target in (docs, docs.limit(0)):
        assert resampled(resample.resample(docs, target, 100, 1)) == plain_resample(rows, [r.text for r in target.collect()], 100, 1)
    assert resample.resample(docs.limit(0), docs).count() == 0
    assert resampled(resample.resample(docs, docs, 50, 0)) == resampled(resample.resample(docs.repartition(5), docs, 50, 0))


def test_hot_bucket_is_dealt_out(spark, monkeypatch):
    """With many salts no co-group holds more than its share of a bucket that all documents hold."""
    monkeypatch.setattr(resample, "POSTINGS", 10)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("the the "), F.col("id").cast("string")).alias("text")).repartition(30)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        blocks = resample.postings(docs, 30).filter("size(bucket) > 0").groupBy("grp", "salt").agg(F.sum(F.size("bucket")).alias("n"))
        assert blocks.agg(F.max("n")).collect()[0][0] < 150
        assert resampled(resample.resample(docs, docs, 10, 1)) == plain_resample([(k, f"the the {k}") for k in range(300)], [f"the the {k}" for k in range(300)], 10, 1)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


# 12 -----------------------------------------------------------------------------------------------


def plain_collocations(docs, most=3, least=10, best=2000, inside=50):
    counts, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(w)
            counts.update((lang, w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    able = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    outer = Counter()
    for (lang, w), a in able.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                outer[lang, w[i : i + k]] = max(outer[lang, w[i : i + k]], a)
    rows = {}
    for (lang, w), a in able.items():
        if 100 * outer[lang, w] >= inside * a and outer[lang, w]:
            continue
        score, k = min((1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
        rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, total[lang], -s) for lang, found in rows.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:best], 1))  # noqa: E741


def mined(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_collocations_equal_sql_and_plain_counting(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = queries.op12_collocations(spark, SMALL)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{SMALL}/documents.parquet'")
    want = db.sql(queries.ORACLES["op12_collocations"]).df()[got.columns]
    rows = mined(got)
    assert rows == sorted(tuple(r) for r in want.astype(object).values.tolist()) and len(rows) > 50
    assert rows == plain_collocations([(r.lang, r.text) for r in docs.collect()])


@pytest.mark.parametrize(("most", "least", "best", "inside"), [(3, 2, 5, 50), (4, 1, 100, 100), (2, 3, 50, 50), (5, 2, 2000, 1)])
def test_collocations_cases(spark, odd, most, least, best, inside):  # noqa: F811
    rng = random.Random(most)
    made = [(k, rng.choice([None, "en", "fr"]), "".join(rng.choice(["a ", "b\t", "c ", "É ", "e. ", "f\n", "g,", "\x85 ", "B "]) for _ in range(60))) for k in range(60)]
    docs = odd.select("doc_id", "lang", "text").union(spark.createDataFrame(made, "doc_id long, lang string, text string")).withColumns({"piece": F.lit("x"), "times": F.lit(9), "phrase": F.lit("y")})
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert mined(colloc.mine(docs, most, least, best, inside)) == plain_collocations(rows, most, least, best, inside)


def test_collocations_on_empty_tables(spark, odd):  # noqa: F811
    assert colloc.mine(odd.limit(0)).count() == 0
    assert colloc.mine(odd.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_collocation_tables_are_handed_on(spark, monkeypatch):
    """Small tables, many blocks: the same counts."""
    docs = spark.createDataFrame([(k, "en", "big data set big data " * (k % 7) + ". " + "big data") for k in range(50)], "doc_id long, lang string, text string")
    rows = [(r.lang, r.text) for r in docs.collect()]
    texts = colloc.pieces(docs)
    assert texts.count() < 10 and texts.agg(F.sum("times")).collect()[0][0] > 80
    monkeypatch.setattr(colloc, "TABLE", 2)
    monkeypatch.setattr(colloc, "MARK_BITS", 20)
    assert mined(colloc.mine(docs)) == plain_collocations(rows)


def test_products_beyond_64_bits(spark):
    big = 10**13
    counts = spark.createDataFrame([("en", "a", big + 7, 1), ("en", "b", big + 9, 1), ("en", "a b", big + 1, 2)], "lang string, phrase string, f long, words int")
    row = colloc.scored(counts).collect()[0]
    assert row.score == 1_000_000 * (big + 1) ** 2 // ((big + 7) * (big + 9))


# 13 -----------------------------------------------------------------------------------------------


def plain_fingerprint(text, n=3):
    w = text_words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, far=2):
    """The least id that each id reaches."""
    ids = sorted(prints)
    above = {i: i for i in ids}

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= far:
                a, b = sorted((root(i), root(j)))
                above[b] = a
    return {i: root(i) for i in ids}


def test_simhash_equals_plain_comparison(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    want = plain_classes(prints)
    got = queries.op13_simhash(spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in prints.items()}
    assert len(got) == len(docs) and len(set(want.values())) < len(want)


def test_simhash_cases(spark, odd):  # noqa: F811
    extra = spark.createDataFrame([(None, "one"), (None, "nobody else has this text"), (77, "ONE")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(extra).withColumns({"fp": F.lit("x"), "rep": F.lit(1), "value": F.lit(2)})
    rows = docs.collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows if r.doc_id is not None}
    want = plain_classes(prints)
    got = simhash.join(docs)
    assert got.count() == len(rows)
    for r in got.collect():
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (prints[r.doc_id], want[r.doc_id])
    assert {r.component_id for r in got.filter("doc_id IS NULL").collect()} == {3, None}
    assert simhash.join(docs.limit(0)).count() == 0


def clustered(n, seed, stem=0):
    """Fingerprints around few centres: chains, hot partitions and bits that go together."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = centres[rng.integers(0, 40, n)]
    for _ in range(4):
        fps = fps ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(fps | np.uint64(stem))


@pytest.mark.parametrize("bucket", [4, 1024])
@pytest.mark.parametrize("plan", [None, [([*range(32)], 1), ([*range(32, 64)], 0)], [([*range(0, 64)], 2)], [([*range(10)], 0), ([*range(10, 30)], 0), ([*range(30, 64)], 0)]])
def test_links_of_any_plan_connect_the_same(spark, monkeypatch, bucket, plan):
    fps = clustered(700, 5, 0xFFF)
    if plan:
        monkeypatch.setattr(simhash, "planned", lambda distinct, far: plan)
    distinct = spark.createDataFrame([(int(f), k) for k, f in enumerate(fps.view(np.int64).tolist())], "fp long, rep long")
    found = simhash.links(distinct, bucket=bucket).collect()
    prints = {k: int(f) for k, f in enumerate(fps)}
    assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 2 for r in found)
    above = {k: k for k in prints}

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for r in found:
        a, b = sorted((root(r.a), root(r.b)))
        above[b] = a
    assert {k: root(k) for k in prints} == plain_classes(prints)


def test_partitions_and_thresholds(spark):
    near = np.eye(64) + np.kron(np.eye(4), np.ones((16, 16)))
    shuffled = np.random.default_rng(1).permutation(64)
    groups = simhash.grouped(near[np.ix_(shuffled, shuffled)], 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and all(len({shuffled[b] // 16 for b in g}) == 1 for g in groups)
    cost = [[0, 50, 70, 90], [0, 10, 80, 99], [0, 20, 30, 99]]
    best = min((sum(c[t + 1] for c, t in zip(cost, (i, j, k), strict=True)), [i, j, k]) for i in range(-1, 3) for j in range(-1, 3) for k in range(-1, 3) if i + j + k == 0)
    assert simhash.allotted(cost, 0) == best
    # A partition of constant bits tells nothing: it is left out where others carry the thresholds.
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 48, 5000, dtype=np.uint64))
    plan = simhash.planned(spark.createDataFrame([(int(f), k) for k, f in enumerate(fps.tolist())], "fp long, rep long"))
    assert sum(len(bits) for bits, _ in plan) <= 64 and all(len([b for b in bits if b < 48]) >= 10 for bits, _ in plan)
