"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import dataclasses
import hashlib
import math
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.llm import ann, bpe, html, jaccard, lines, lm, mix, ordermin, pii, toxicity

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Few documents of every awkward kind, with a column that clashes with inner names."""
    base = " ".join(f"word{k}" for k in range(200))
    texts = [
        None, "", "   \n\t ", "one", "a b c d", base, base, base.replace("word7 ", "other "), base.upper(), "x" * 30_000, "ab " * 20_000,
        "line one\nfooter\nend", "line two\nfooter\n\nend", "mail a@b.co or jo(at)ho(dot)st, +1 (487) 555-7209, 1.2.3.4", "аб éè \U0001f600 ok",
    ]
    rows = [(k, t, "en", None if k % 4 == 0 else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)] + [(5, base, "en", "s2", len(base))]
    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit(1)).withColumn("token", F.lit("x"))


def text_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


# 1 ------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    got = toxicity.scored(read("documents"), read("labels")).toPandas()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(got.doc_id, got.held_out, strict=True))
    both = got.merge(read("labels").toPandas(), on="doc_id").query("held_out")
    assert (both.predicted == both.toxic).mean() > 0.85 and got.score.between(0, 1).all()


def test_toxicity_cases(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.scored(odd, none).filter("score > 0.01").count() == 0
    labels = spark.createDataFrame([(k, 1, int(k % 2)) for k in range(15)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(odd, labels).count() == odd.count()
    assert toxicity.scored(odd.limit(0), labels).count() == 0
    both = labels.union(labels.withColumn("toxic", 1 - F.col("toxic")))
    one = toxicity.scored(odd, both.repartition(3)).orderBy("doc_id", "score").collect()
    assert one == toxicity.scored(odd, both.repartition(7)).orderBy("doc_id", "score").collect()
    kept = toxicity.clean(odd, none)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_label_model_weighs_correlated_voters_down():
    rng = np.random.default_rng(0)
    y = (rng.random(600) < 0.3).astype(float)
    good = np.where(rng.random(600) < 0.85, y, 1 - y)
    copy = np.where(rng.random(600) < 0.6, y, 1 - y)
    votes = np.stack([good, copy, copy, copy], 1)
    model, post = toxicity.fit_label_model(votes, y)
    assert model.share[0] > model.share[1] and ((post > 0.5) == y).mean() > 0.9


# 2 ------------------------------------------------------------------------------------------------


def test_order_minhash_contract(spark, odd):
    rows = odd.dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in ordermin.compare_edited(rows).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in rows.collect())
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode("utf-8")).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[5].fingerprint == got[6].fingerprint and got[5].near_next == 1.0 and got[0].fingerprint == got[1].fingerprint
    assert ordermin.compare_edited(rows.limit(0)).count() == 0
    plan = ordermin.compare_edited(rows)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def spark_hash(*values):
    """Spark's xxhash64: 64-bit XXH with seed 42, each column's hash the next one's seed; ints take 4 bytes, longs 8."""
    seed = 42
    for kind, v in values:
        raw = v.encode() if kind == "s" else struct.pack("<i" if kind == "i" else "<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed & (1 << 64) - 1)
    return signed(seed)


def plain_order_minhash(text, m=64):
    """The fingerprint by direct selection: each hash function's two least k-mers, in text order."""
    low = (1 << 24) - 1
    w = re.findall(r"[^\x20\x09-\x0D]{1,12}", text)
    if not w:
        return [0] * m
    grams = [("s", w[0])] and ([spark_hash(("s", w[0]))] if len(w) < 2 else [spark_hash(("s", a), ("s", b)) for a, b in zip(w, w[1:], strict=False)])
    seen, marks = Counter(), []
    for pos, h in enumerate(grams):
        h &= ~low
        nth = seen[h]
        seen[h] += 1
        marks.append((h if nth == 0 else spark_hash(("q", h >> 24), ("i", nth)) & ~low) | pos)
    out = []
    for j in range(m):
        probe = signed(((j - m // 2) << 58) % (1 << 64)) | low
        first, second = (sorted(marks, key=lambda x: (x - probe) % (1 << 64)) * 2)[:2]
        a, b = sorted((first, second), key=lambda x: x & low)
        out.append(spark_hash(("q", a >> 24), ("q", b >> 24)) & 0xFFFFFFFF)
    return out


def test_order_minhash_against_plain_selection(spark):
    rng = np.random.default_rng(5)
    texts = ["", "one", "a b", "a b a b a c", "c a b a b a", "x" * 100 + " \u00e9t\u00e9 y", " ".join(f"w{k}" for k in rng.integers(0, 30, 200)), " ".join(f"w{k}" for k in rng.integers(0, 5000, 300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.sig) for r in ordermin.fingerprinted(rows, "text", "sig").collect()}
    assert got == {k: plain_order_minhash(t) for k, t in enumerate(texts)}
    assert got[3] != got[4]


def test_order_minhash_of_repeated_and_null_ids(spark):
    """Rows that repeat an id follow each other by text; null ids come first; no row is lost."""
    rows = [(3, "c c"), (None, "n n"), (1, "b b"), (1, "a a"), (1, "a a"), (None, None)]
    got = ordermin.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    alike = [r.near_next for r in got if r.doc_id == 1]
    assert sorted(alike) == [0.0, 0.0, 1.0]


# 3 ------------------------------------------------------------------------------------------------


def exact(x, ids, q, k):
    score = (x * x[list(ids).index(q)]).sum(1)
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
    return [(int(ids[j]), float(score[j])) for j in order]


def test_ann_recall_and_scores(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = ann.search(table, table.filter("vec_id % 20 = 0")).toPandas()
    frame = table.toPandas()
    x, ids = np.stack(frame.embedding.to_numpy()).astype(float), frame.vec_id.to_numpy()
    hits = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        want = exact(x, ids, q, 20)
        hits += len({v for v, _ in want} & set(own.vec_id))
        near = dict(exact(x, ids, q, len(ids)))
        assert list(own["rank"]) == list(range(1, 21)) and all(abs(near[v] - s) < 1e-12 for v, s in zip(own.vec_id, own.score, strict=True))
    assert hits / (20 * got.query_id.nunique()) >= 0.9


def test_ann_on_clustered_vectors(spark):
    """Many parts, few of them probed, recall against brute force over 0.9."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((120, 16))
    x = (centres[rng.integers(0, 120, 20_000)] + 0.25 * rng.standard_normal((20_000, 16))).astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    router = ann.fit(x[:8192].astype(float), len(x))
    assert router.w2.shape[1] >= 8 and router.probes <= router.w2.shape[1] // 2
    got = ann.search(table, table.filter("vec_id % 200 = 0")).toPandas()
    hits = sum(len({v for v, _ in exact(x.astype(float), range(len(x)), q, 20)} & set(own.vec_id)) for q, own in got.groupby("query_id"))
    assert hits / len(got) >= 0.9


def test_ann_cases(spark):
    rows = [(k, [1.0, 0.0]) for k in range(60)] + [(60, None), (61, [0.0, 0.0]), (62, [float("nan"), 1.0]), (63, [1.0, None]), (64, [1.0]), (80, [0.5, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit("x"))
    got = ann.search(table, table.filter("vec_id % 20 = 0"), 5).toPandas()
    assert set(got.query_id) == {0, 20, 40, 80}
    assert list(got[got.query_id == 20].sort_values("rank").vec_id) == [0, 1, 2, 3, 4]
    assert ann.search(table.limit(0), table.limit(0)).count() == 0
    twice = table.filter("vec_id < 3").union(spark.createDataFrame([(0, [1.0, 0.0], "x"), (0, [0.0, 1.0], "x")], "vec_id long, embedding array<float>, part string"))
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(twice, twice.filter("vec_id = 0")).collect())
    assert got == Counter({(0, 1, 1, 1.0): 2, (0, 2, 2, 1.0): 2, (0, 1, 1, 0.0): 1, (0, 2, 2, 0.0): 1})
    two = table.filter("vec_id < 3")
    assert ann.search(two, two.filter("vec_id = 0")).count() == 2


# 4 ------------------------------------------------------------------------------------------------


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def plain_spans(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab1234.@+-() 56%é", max_size=60))
def test_pii_base_equals_patterns(t):
    assert pii.plain(t) == plain_spans(t)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write john (at) mail (dot) com now", "john (at) mail (dot) com"),
        ("jоhn@exаmple.com", "jоhn@exаmple.com"),
        ("call plus four nine one two three four five six seven eight", "plus four nine one two three four five six seven eight"),
        ("ip one nine two dot 168.0.1 x", "one nine two dot 168.0.1"),
    ],
)
def test_pii_disguises_map_back(text, want):
    found = pii.disguised(text, pii.plain(text))
    assert [text[a:b] for a, b, _ in found] == [want]


def test_pii_long_runs_are_linear():
    import time

    begin = time.process_time()
    for text in ("a (at) b" + " " * 200_000, "one two " * 20_000, "a@b.co " * 20_000 + "x (at) y (dot) zz", "( " * 50_000 + "(at)", "jo (at) (dot) me"):
        pii.disguised(text, pii.plain(text))
    assert time.process_time() - begin < 10


def test_pii_table(spark, odd):
    got = {r.doc_id: r for r in pii.find(odd).collect()}
    assert got[13].n_email == 1 and got[13].n_ip == 1 and got[13].n_phone == 1 and got[13].n_added == 1
    assert got[0].spans == "" and pii.find(odd.limit(0)).count() == 0 and pii.find(odd).count() == odd.count()
    assert "[email]" in pii.redact(odd).filter("doc_id = 13").collect()[0].text


# 5 ------------------------------------------------------------------------------------------------


def test_lines_drop_by_site(spark):
    rows = [(k, f"u{k} own\nfooter\n\nfooter", "a" if k < 6 else "b" if k < 8 else None) for k in range(10)] + [(10, None, "a"), (11, "", "a"), (12, "alone\nfooter", "c")]
    pages = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("line", F.lit(1)).withColumn("host", F.lit(2))
    got = {r.doc_id: r for r in lines.dedup(pages, F.col("source"), ratio=0.5).collect()}
    assert got[0].text == "u0 own\n" and got[0].n_dropped == 2 and got[7].n_dropped == 2 and got[9].n_dropped == 2
    assert got[10].text is None and got[10].n_lines == 0 and got[11].text == ""
    assert got[12].text == "alone\nfooter" and got[12].n_dropped == 0
    assert lines.dedup(pages.limit(0), F.col("source")).count() == 0
    assert spark.range(1).select(lines.host_of(F.lit("https://me@WWW.Ex.org:80/x"))).collect()[0][0] == "www.ex.org"


def test_lines_of_repeated_rows_and_long_texts(spark):
    """Repeated rows are pages of their own; a very long text keeps its own lines and loses the site's."""
    long = "\n".join([f"line {k}" for k in range(20_000)] + ["footer"])
    rows = [(1, long, "a"), (2, "x\nfooter", "a"), (3, "y", "a"), (3, "y", "a"), (4, "z", "a"), (5, "w", "a")]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source"), ratio=0.3).collect()
    assert len(got) == 6 and {r.doc_id: r.n_dropped for r in got} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}
    assert next(r.text for r in got if r.doc_id == 1) == long.removesuffix("\nfooter")


def test_lines_of_pages(spark):
    html = "<html><head><title>no</title></head><body class='x'><script>var a='<p>';</script><p>one <b>two</b><P>three<br/>four<!-- <p>no --><table><tr><td>a</td></tr></table>"
    got = spark.createDataFrame([(html,), (None,)], "html string").select(lines.lines_of_html(F.col("html")).alias("t")).collect()
    assert [x for x in got[0].t.split("\n") if x] == ["one two", "three", "four", "a"] and got[1].t is None
    kept = lambda page: spark.createDataFrame([(page,)], "html string").select(lines.lines_of_html(F.col("html")).alias("t")).collect()[0].t
    assert kept("a <b>c</b> < d") == "a c < d" and kept("a<!-- b <p>c") == "a" and kept("a<script x") == "a" and kept("plain") == "plain" and kept("") == ""
    for piece in ("<!--", "<script>", "<script ", "<", "<p ", "<p", "<!-- -->", "</script", "<style>x"):
        begin = time.perf_counter()
        kept(piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - begin < 10, piece


def test_line_dedup_leaves_other_columns(spark):
    pages = spark.createDataFrame([(1, "x\nfooter", "a", 77, 78)] * 3, "doc_id long, text string, source string, n_lines long, n_dropped long")
    left = lines.dedup(pages, F.col("source"), ratio=0.5, counts=None)
    assert left.columns == pages.columns and {tuple(r)[1:] for r in left.collect()} == {("", "a", 77, 78)}
    assert lines.dedup(pages, F.col("source"), ratio=0.5, counts=("of", "gone")).columns == [*pages.columns, "of", "gone"]


# 6 ------------------------------------------------------------------------------------------------


def test_lm_counts_and_model(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = lm.score(docs).toPandas()
    texts = {r.doc_id: text_words(r.text) + [None] for r in docs.select("doc_id", "text").collect()}
    count = Counter(w for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    for r in got.itertuples():
        ws = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) and r.score < 0


@pytest.fixture(scope="module")
def small_lm():
    """A model with trained attention and counts of a few words, and the vocabulary's path."""
    import public_tokenizers

    path = public_tokenizers.path(lm.VOCABULARY)
    _, begins = lm.known_vocabulary(path)
    found = text_words("the quick brown fox jumps over the lazy dog and runs away from antidisestablishmentarianism \u00e9t\u00e9 " * 4)
    ids, first = lm.coded([w.encode() for w in found], path)
    count = np.bincount(ids, minlength=lm.SIZE).astype(float)
    cls = lm.classes(np.random.default_rng(0).random((lm.SIZE, 2 * lm.SLOTS + 2)).astype(np.float32), count, begins)
    cls[ids] = np.where(begins[ids], 1 + ids % lm.BEGINNING, 1 + lm.BEGINNING + ids % (lm.CLASSES - 1 - lm.BEGINNING))
    sym = lm.OWN + cls
    sym[np.unique(ids)[: lm.OWN]] = np.arange(min(lm.OWN, len(np.unique(ids))))
    sym[lm.END] = lm.AT_END
    inside = np.flatnonzero(~first)
    model = lm.with_counts(lm.start(np.bincount(cls, count, lm.CLASSES)), cls, sym, begins, count, sym[ids[inside - 1]], ids[inside], np.ones(len(inside)))
    inputs, goal, _ = lm.blocks_of(sym[ids].astype(np.uint8), cls[ids].astype(np.uint8), np.array([len(ids)]))
    held = inputs.reshape(-1, lm.HALF)
    windows = np.concatenate([np.concatenate([np.full((1, lm.HALF), lm.PAD, np.uint8), held[:-1]]), held], 1)
    words_, many = np.unique(found, return_counts=True)
    model.keys, model.held = lm.prefix_tree([w.encode() for w in words_], many.astype(float), path)
    model.ends = 3.0
    model.params = lm.train(model.params, np.tile(windows, (40, 1)), np.tile(np.where(goal == 255, -1, goal.astype(int)).reshape(-1, lm.HALF), (40, 1)))
    return model, path, ids


def steps_of(model, path, seqs):
    """log10 p of each id and of the end of each sequence of ids, by the path that scores texts: words are cut where ids begin them."""
    bpe, begins = lm.known_vocabulary(path)
    known = lm.Coded(model, path)
    known.most = 0
    out = []
    for s in seqs:
        out.append(lm.steps(model, known, *forced(known, np.asarray(s, np.int64), begins)))
    return out


def forced(known, ids, begins):
    """The ids as words of the table, whether or not their letters would be coded so."""
    known.reset()
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    starts = np.flatnonzero(begins[ids])
    assert starts[0] == 0
    parts = np.split(ids, starts[1:])
    keep, lm.coded = lm.coded, lambda found, path: (ids, begins[ids])
    try:
        numbers = known.numbers([str(k).encode() for k in range(len(parts))])
    finally:
        lm.coded = keep
    return numbers, np.zeros(len(numbers), np.int64), 1


@pytest.mark.parametrize("n", [1, 2, 5, 31, 32, 33, 47, 64])
def test_lm_mass_is_one(small_lm, n):
    """In many contexts the probabilities of all ids and of the end sum to 1: those of all ids in a row, taken from one batch."""
    model, path, ids = small_lm
    begins = lm.known_vocabulary(path)[1]
    prefix = ids[:n]
    mass = 10.0 ** steps_of(model, path, [prefix])[0][1][0]
    # Each text is the prefix's words, of which the last goes on with one id or another word begins with it.
    last = np.flatnonzero(begins[prefix])[-1]
    head, tail = prefix[:last], prefix[last:]
    known = lm.Coded(model, path)
    every = np.arange(lm.END)
    texts = [np.concatenate((tail, [k])) for k in every]
    flat = np.concatenate([head, *texts]).astype(np.int64)
    first = np.zeros(len(flat), bool)
    first[np.flatnonzero(begins[head])] = True
    at = len(head) + np.arange(len(every)) * (len(tail) + 1)
    first[at] = True
    first[at + len(tail)] = begins[every]
    keep, lm.coded = lm.coded, lambda found, path: (flat, first)
    try:
        made = known.numbers([str(k).encode() for k in range(int(first.sum()))])
    finally:
        lm.coded = keep
    heads = made[: int(begins[head].sum())]
    rest, more = made[len(heads) :], 1 + begins[every].astype(int)
    ends = np.cumsum(more)
    numbers = np.concatenate([np.concatenate((heads, rest[a:b])) for a, b in zip(ends - more, ends, strict=True)])
    owner = np.repeat(np.arange(len(every)), len(heads) + more)
    by_id, _ = lm.steps(model, known, numbers, owner, len(every))
    mass += (10.0 ** by_id[n :: n + 1]).sum()
    assert mass == pytest.approx(1, abs=3e-4)


def test_lm_scoring_equals_the_trained_function(small_lm):
    """Each id is scored once, as `forward` gives it on the windows that overlap by half."""
    model, path, ids = small_lm
    inputs, goal, first = lm.blocks_of(model.sym[ids].astype(np.uint8), model.cls[ids].astype(np.uint8), np.array([len(ids)]))
    got = lm.class_probabilities(model.params, inputs, goal, first)
    held = inputs.reshape(-1, lm.HALF)
    logits, _ = lm.forward(model.params, np.concatenate([np.concatenate([np.full((1, lm.HALF), lm.PAD, np.uint8), held[:-1]]), held], 1))
    prob = np.exp(logits - logits.max(-1, keepdims=True)).reshape(-1, lm.CLASSES)
    prob /= prob.sum(-1, keepdims=True)
    there = np.flatnonzero(goal != 255)
    assert len(there) == len(ids) + 1 and np.allclose(got[there], prob[there, goal[there]], atol=1e-5)
    words_ = [b"the", b"quick", b"brown"]
    known = lm.Coded(model, path)
    numbers = known.numbers(words_ * 20 + words_)
    owner = np.repeat([0, 1], [60, 3])
    by_id, _ = lm.steps(model, known, numbers, owner, 2)
    n = len(by_id) // 21
    assert np.allclose(by_id[:n], by_id[-n:], atol=1e-5)  # texts of a batch don't see each other


def test_lm_words_are_coded_whole():
    import public_tokenizers

    path = public_tokenizers.path(lm.VOCABULARY)
    bpe, _ = lm.known_vocabulary(path)
    for word in ("a", "\u00e9t\u00e9", "x" * 5000, "\x85\xa0", "the"):
        ids, begins = lm.coded([word.encode(), b"z"], path)
        assert bpe.decode(ids.tolist()) == f" {word} z" and np.flatnonzero(begins).tolist()[0] == 0 and begins.sum() == 2
        assert ids[: np.flatnonzero(begins)[1]].tolist() == bpe.encode_ordinary(" " + word)


def test_lm_learns_from_every_text(spark):
    """Windows come from long and short training texts, their number grows with the corpus, and training lowers the loss."""
    import public_tokenizers

    path = public_tokenizers.path(lm.VOCABULARY)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, counts, texts = lm.fit(docs, path)
    held = spark.sparkContext.broadcast(model)
    some = [lm.training_windows(lm._training(lm._texts(part)), held, path).count() for part in (docs.filter("doc_id % 4 = 0"), docs)]
    assert 2.5 < some[1] / some[0] < 6
    one_long = spark.createDataFrame([(1, "word " * 100_000), (2, "word")], "doc_id long, text string")
    assert lm.training_windows(one_long, held, path).count() >= 100_000 // lm.APART
    found = [text_words(r.text) for r in docs.filter(lm.remainder(F.col("doc_id"), 7) == 2).collect()]
    owner = np.repeat(np.arange(len(found)), [len(w) for w in found])
    totals = []
    for params in (model.params, lm.start(np.bincount(model.cls, minlength=lm.CLASSES).astype(float))):
        model.params = params
        known = lm.Coded(model, path)
        totals.append(lm.text_scores(model, known, known.numbers([w.encode() for t in found for w in t]), owner, len(found)).sum())
    assert totals[0] > 0.97 * totals[1] > totals[1]  # nearer to 0 by 3 % at least, on texts that it didn't learn from


def test_lm_trains_on_every_id(spark, small_lm):
    """Each id and each end of each text is a goal of one window, behind the ids that scoring shows it."""
    model, path, _ = small_lm
    texts = [None, "", "fox", *("the lazy dog " * n for n in (1, 10, 11, 500)), "quick " * 3000 + "brown", "fox"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = lm.training_windows(docs, spark.sparkContext.broadcast(model), path).collect()
    syms, goal = lm.windows_of([bytes(r.w) for r in rows], lm.goals_of(model))
    known = lm.Coded(model, path)
    want = []
    for text in texts:
        some, cls, _, _ = known.flat(known.numbers(lm.words(text)))
        inputs, goals, _ = lm.blocks_of(some, cls, np.array([len(some)]))
        held = inputs.reshape(-1, lm.HALF)
        before = np.concatenate([np.full((1, lm.HALF), lm.PAD, np.uint8), held[:-1]])
        want += [(b.tobytes(), h.tobytes(), g.tobytes()) for b, h, g in zip(before, held, goals.reshape(-1, lm.HALF), strict=True)]
    assert Counter((s[: lm.HALF].tobytes(), s[lm.HALF :].tobytes(), g.astype(np.uint8).tobytes()) for s, g in zip(syms, goal, strict=True)) == Counter(want)
    assert len({r.h for r in rows}) == len(rows) > len(texts)


def test_lm_reads_words_a_column_at_a_time(small_lm):
    """Words of a column are those of its texts one by one, and each is looked up once however often it stands there."""
    model, path, _ = small_lm
    rng = np.random.default_rng(3)
    letters = list(" \t\n\x0b\x0c\r\x1c\x1f\x00aBcZ\u00c9\u00a0\u3000\u00df\u0130\x85")
    texts = [None, "", " ", " a", "a ", "A" * 70, *("".join(rng.choice(letters, n)) for n in rng.integers(0, 30, 500)), "the fox " * 2000]
    for some in (pa.array(texts), pa.array(texts).slice(3, 90), pa.array([], pa.string()), pa.array([None], pa.string())):
        found, counts = lm.found_words(some)
        each = [lm.words(text) for text in some.to_pylist()]
        assert found.to_pylist() == [w for ws in each for w in ws] and counts.tolist() == [len(ws) for ws in each]
    asked = []
    known = lm.Coded(model, path)
    keep = known.numbers
    known.numbers = lambda words_: asked.extend(words_) or keep(words_)
    numbers, counts = known.read(pa.array(texts))
    assert [known.names[k] for k in numbers] == [w for text in texts for w in lm.words(text)] and len(counts) == len(texts)
    assert len(asked) == len(set(asked)) < len(numbers) / 2


def test_lm_tree_is_looked_up_by_leads(small_lm):
    """The tree's counts are those of a plain search, at any number of keys, in ranges that hold many keys or none."""
    model = dataclasses.replace(small_lm[0])
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 1000):
        spread = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
        for keys in (spread, spread >> np.uint64(40), spread | np.uint64(0xFFFF << 48)):
            model.keys = np.unique(np.concatenate((lm.ROOT, keys)))
            model.held = rng.random(len(model.keys))
            asked = np.concatenate((model.keys, model.keys + np.uint64(1), [np.uint64(2**64 - 1)]))
            want = dict(zip(model.keys.tolist(), model.held.tolist(), strict=True))
            assert model.count(asked).tolist() == [want.get(k, 0) for k in asked.tolist()]


def test_lm_scoring_far_from_trained_scale(small_lm):
    """Logits beyond what powers hold still give probabilities that sum to 1."""
    model, _, ids = small_lm
    params = {n: x * (40 if n in ("u", "q") else 1) for n, x in model.params.items()}
    inputs, _, first = lm.blocks_of(model.sym[ids].astype(np.uint8), model.cls[ids].astype(np.uint8), np.array([len(ids)]))
    every = [lm.class_probabilities(params, inputs, np.full(len(inputs), k, np.uint8), first) for k in range(lm.CLASSES)]
    there = inputs != lm.PAD
    assert np.allclose(np.sum(every, 0)[there], 1, atol=1e-4)


def test_lm_slopes():
    """The backward pass against differences."""
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lm.start().items()}
    ids = rng.integers(0, 50, (2, 2 * lm.HALF))
    ids[0, : lm.HALF] = lm.PAD
    weigh = rng.standard_normal((2, lm.HALF, lm.CLASSES))
    slopes = lm.backward(p, ids, lm.forward(p, ids)[1], weigh)
    for name in ("q", "k", "v", "o", "w1", "w2", "u", "rel", "emb"):
        at = (int(ids[1, 3]), 2) if name == "emb" else tuple(rng.integers(0, n) for n in p[name].shape)
        keep = p[name][at]
        loss = []
        for step in (1e-5, -1e-5):
            p[name][at] = keep + step
            loss.append((lm.forward(p, ids)[0] * weigh).sum())
        p[name][at] = keep
        assert slopes[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-5, rel=1e-3, abs=1e-4)


def test_lm_cases(spark, odd):
    got = {r.doc_id: r for r in lm.score(odd).collect()}
    assert got[0].n_tokens == 1 and got[9].n_tokens == 2 and got[10].n_tokens == 20_001
    assert lm.score(odd).count() == odd.count() and lm.score(odd.limit(0)).count() == 0


# 7 ------------------------------------------------------------------------------------------------


def brute_components(texts):
    sets, above = {}, {}
    for i, t in texts.items():
        w = text_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        above[i] = i

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts, k = {}, 0
    for size in (3, 5, 9, 30, 60, 120, 400):
        for _ in range(3):
            base = [f"w{rng.integers(0, 5000)}" for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 3, size // 20, size // 12, size // 6):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.integers(0, size)] = f"w{rng.integers(0, 5000)}"
                texts[k] = " ".join(copy)
                k += 1
    want = brute_components(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert got == want


def test_jaccard_cases(spark, odd):
    rows = odd.dropDuplicates(["doc_id"])
    want = brute_components({r.doc_id: r.text for r in rows.collect()})
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(rows).collect()} == want
    assert jaccard.join(odd).count() == odd.count() and jaccard.join(odd.limit(0)).count() == 0
    assert sorted(r.doc_id for r in jaccard.first_of_groups(odd).collect()) == [k for k in range(15) if k not in (6, 7, 8)]


def test_texts_that_share_an_id_are_kept_apart(spark):
    base = " ".join(f"w{k}" for k in range(60))
    near, other, alone = base.replace("w59", "z"), " ".join(f"v{k}" for k in range(60)), " ".join(f"u{k}" for k in range(60))
    rows = [(1, base), (2, base), (2, other), (2, other), (3, alone), (3, alone + " end"), (4, near), (None, base), (None, base), (5, other), (6, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("x"), "own": F.lit(1)})
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()) == sorted([
        (1, 56, 1), (2, 56, 1), (2, 56, 2), (2, 56, 2), (3, 56, 3), (3, 57, 3), (4, 56, 1), (0, 56, 1), (0, 56, 1), (5, 56, 2), (6, 0, 6), (6, 0, 6),
    ])
    left = sorted((r.doc_id or 0, r.text or "") for r in jaccard.first_of_groups(docs).collect())
    three = [t for i, t in left if i == 3]
    assert [x for x in left if x[0] != 3] == sorted([(1, base), (2, other), (0, base), (0, base), (6, ""), (6, "")]) and len(three) == 1 and three[0] in (alone, alone + " end")
    assert jaccard.first_of_groups(docs).columns == docs.columns



def test_word_hashes_match_words():
    for t in ("", " a  b\tA\x0bb ", "q" * 70_000 + " z " + "Q" * 70_000, "é É e"):
        assert len(jaccard.word_hashes(t)) == len(text_words(t)) and len(set(jaccard.word_hashes(t).tolist())) == len(set(text_words(t)))


# 8 ------------------------------------------------------------------------------------------------


def test_mix_targets_and_quotas():
    got = mix.targets([100, 100, 100, 100])
    assert sum(got) == pytest.approx(600) and max(got) <= 200 + 1e-9
    assert mix.targets([0, 0]) == [0, 0] and mix.targets([]) == []
    parts = mix.split([70, 30, 11], 8)
    assert [sum(p[k] for p in parts) for k in range(3)] == [70, 30, 11] and {sum(p) for p in parts} <= {13, 14}


def test_mix_of_table(spark, odd):
    got = mix.taken_by_document(odd).toPandas()
    assert len(got) == odd.count() and (got.taken <= 2 * got["size"]).all()
    for target, part in got.groupby("target"):
        n = max(1, round(part["size"].sum() / part["source_size"].iloc[0]))
        assert abs(part.taken.sum() - n * target) <= n
    again = mix.taken_by_document(odd.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))
    assert mix.taken_by_document(odd.limit(0)).count() == 0
    rows, taken = mix.mix(odd)
    spans = taken.groupBy("doc_id", "source", "text_key", "copy", "epoch", "block").count().filter("count > 1")
    assert spans.count() == 0 and taken.select("shard").distinct().count() > 1


@pytest.mark.parametrize("block_words", [7, 256])
def test_mix_against_plain_draws(spark, odd, block_words):
    """What the shards draw, block by block: the first blocks of each source's permutations up to its target, in runs whose lengths the tree gives."""
    rows = mix.sized(odd)
    sizes = Counter()
    for r in rows.collect():
        sizes[r.source] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mix.targets([sizes[s] for s in order]), strict=True))
    made = rows.filter("size > 0").withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((size - 1) DIV {block_words} AS INT)"))))
    made = made.withColumn("h", F.xxhash64("doc_id", "text_key", "copy", "block", "epoch", F.lit(7)))
    queues = {}
    for r in made.collect():
        queues.setdefault((r.source, r.epoch), []).append((r.h, r.doc_id, r.text_key, r.copy, r.block, min(block_words, r["size"] - r.block * block_words)))
    want, drawn = [], {}
    for s in order:
        left, drawn[s] = round(target[s]), []
        for epoch in range(3):
            for _, doc, _, copy, block, n in sorted(queues.get((s, epoch), [])):
                if left > 0:
                    drawn[s].append((doc, copy, epoch, block, min(n, left)))
                    left -= n
        want += [(s, *x) for x in drawn[s]]
    _, taken = mix.mix(odd, shards=5, block_words=block_words)
    got = taken.collect()
    key = lambda x: (x[0] is None, x[0] or "", *x[1:])
    assert sorted([(r.source, r.doc_id, r.copy, r.epoch, r.block, r.n_words) for r in got], key=key) == sorted(want, key=key)
    some = [s for s in order if drawn[s]]
    quotas = mix.split([len(drawn[s]) for s in some], 5)
    place = {(s, *x[:4]): k for s in some for k, x in enumerate(drawn[s])}
    ends = {s: np.cumsum([q[k] for q in quotas]) for k, s in enumerate(some)}
    assert all(np.searchsorted(ends[r.source], place[r.source, r.doc_id, r.copy, r.epoch, r.block], side="right") == r.shard for r in got)


def test_mix_without_some_shards_takes_less(spark, odd, monkeypatch):
    """The tree decides what is taken: a tree that gives its first half nothing leaves that half's blocks out."""
    whole = mix.taken_by_document(odd).agg(F.sum("taken")).collect()[0][0]
    keep = mix.split
    monkeypatch.setattr(mix, "split", lambda quotas, shards, seed=7: [[q // 2 for q in quotas] if k == 0 else [0] * len(quotas) for k in range(shards)])
    half = mix.taken_by_document(odd).agg(F.sum("taken")).collect()[0][0]
    monkeypatch.setattr(mix, "split", keep)
    assert 0 < half < whole


def test_mixed_documents_hold_the_words_taken(spark, odd):
    docs = odd.drop("size", "token")
    got = mix.mixed_documents(odd)
    assert got.columns == odd.columns
    words = got.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))
    taken = mix.taken_by_document(docs).groupBy("doc_id").agg(F.sum("taken").alias("n")).filter("n > 0")
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, taken.collect()))


# 9 ------------------------------------------------------------------------------------------------


def test_bpe_equals_library(spark, odd):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(99, "we'll  12 \n\n x y   'S don't \x85 z" + "ab" * 300)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = bpe.encode(docs)
    for r in rows.collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert {r.doc_id: r.text for r in bpe.decode(rows).collect()} == texts
    assert bpe.encode(docs.limit(0)).count() == 0


def test_bpe_long_words():
    """Unbroken words of up to 30,000 letters, in a database of 150 MB."""
    import public_tokenizers as P
    import tiktoken

    coder = bpe.Encoder(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rng = np.random.default_rng(3)
    word = lambda letters, n: "".join(rng.choice(list(letters), n))
    az = "abcdefghijklmnopqrstuvwxyz"
    texts = ["x" * 30_000, word(az, 30_000), word("ab", 9000), "ab" * 5000 + "a", word("\u4e00\u4e8c\u4e09\u00e9", 3000), " ".join(word(a, n) for a in (az, "aeinst", "th") for n in range(62, 90)), "=" * 999 + "-" * 1001]
    coded = coder.encode(texts)
    for text, ids, back in zip(texts, coded, coder.decode(coded), strict=True):
        want = enc.encode_ordinary(text)
        assert ids == struct.pack(f"<{len(want)}I", *want) and back == text.encode()


def test_bpe_decodes_ids_alone_in_spans(monkeypatch):
    """Decoding knows nothing but ids, and a text of many spans comes back whole."""
    import public_tokenizers as P

    monkeypatch.setattr(bpe, "SPAN", 7)
    coder, fresh = bpe.Encoder(P.path("byte_bpe_50k.tiktoken")), bpe.Encoder(P.path("byte_bpe_50k.tiktoken"))
    texts = ["", "one two three four five six seven eight nine ten eleven", "\u00e9\u4e00 x", "", "a"]
    assert list(fresh.decode(coder.encode(texts))) == [t.encode() for t in texts] and not fresh.pieces


# 10 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
        ("<ul><li>x<li>y<ol><li>z</ol></ul>", "- x\n- y\n 1. z"),
        ("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>", "aa  b\nc   dd"),
        ("<style>p{}</style><p hidden>no</p><p style='display:none'>no</p>yes<script>var t='</p>'</script>", "yes"),
        ("a &amp; b<br>c <b>d</b>", "a & b\nc d"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_html_layout(source, want):
    got = html.text_of(source)
    assert re.sub(r"\n\n+", "\n", got) == re.sub(r"\n\n+", "\n", want)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p class='hidden md:block'>a</p><p class=\"a hidden b\">b</p><p title='the hidden door'>c</p>", "a\nb\nc"),
        ("<p style='overflow: hidden !important'>a</p><p data-css='display:none'>b</p><p aria-hidden='true'>c</p>", "a\nb\nc"),
        ("<p hidden=''>no</p><p HIDDEN>no</p><p style='color:red; DISPLAY : none !important'>no</p><p style=visibility:hidden>no</p>yes", "yes"),
        ("<p style='display:none;display:block'>a</p><p style='/*display:none*/'>b</p>", "a\nb"),
        ("<svg><title>no</title><defs><text>no</text></defs><path d=''/><defs/><text>in <tspan>svg</tspan></text><text>b</text></svg>", "in svg b"),
        ("<select><option>a<option selected>b<option>c</select>", "b"),
        ("<select><option disabled>a<option>b</select><select multiple><option>c<option>d</select>", "b c\nd"),
    ],
)
def test_html_shows_all_that_is_visible(source, want):
    assert re.sub(r"\n\n+", "\n", html.text_of(source)) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<div style='visibility:hidden'>no<p style='visibility:visible'>yes<b style='visibility:hidden'>no</b></div>", "yes"),
        ("<div style='display:none'>no<p style='display:block;visibility:visible'>no</div>a", "a"),
        ("<table><tr><td colspan=2>head<td>x<tr><td>a<td>b<td>c</table>", "head  x\na  b  c"),
        ("<table><tr><td rowspan=2>tall<td>x<tr><td>y<tr><td>a<td>b</table>", "tall  x\n      y\na     b"),
        ("<table><tr><td>a<td>b<tr><td colspan='2'>a wide one<tr><td>c<td>d<td>e</table>", "a  b\na wide one\nc  d        e"),
        ("<table><tr><td colspan=bad>a<td colspan=0>b</table>", "a  b"),
    ],
)
def test_html_visibility_and_spans(source, want):
    assert re.sub(r"\n\n+", "\n", html.text_of(source)) == want


@pytest.mark.parametrize("piece", ["<div>", "<p><b>", "<ul><li>", "<b></i>", "<blockquote>x", "<p><button><div/>", "<table><td>", "<i><table><td><b></i>"])
def test_html_deep_nesting_is_linear(piece):
    import time

    n = 100_000 // (1 + piece.count("<")) if "table" not in piece else 300
    begin = time.process_time()
    assert "deep" in html.text_of(piece * n + "deep")
    assert time.process_time() - begin < 4


def _tree(rng, depth):
    """A random tree of (tag, attrs, kids); words are strings."""
    tag = rng.choice(["div", "p", "b", "span", "ul", "section", "h2"])
    attrs, gone = rng.choice([("", False)] * 8 + [(" class='hidden'", False), (" hidden", True), (" style='display:none'", True), (" title='hidden'", False)])
    if tag == "ul":
        kids = [("li", "", False, [f"w{rng.random():.9f}"] + ([_tree(rng, depth - 1)] if depth and rng.random() < 0.3 else [])) for _ in range(rng.randint(1, 3))]
    else:
        inline = tag in ("p", "b", "span", "h2")
        kids = []
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.5 or not depth:
                kids.append(f"w{rng.random():.9f}")
            else:
                kid = _tree(rng, depth - 1)
                while inline and kid[0] not in ("b", "span"):
                    kid = _tree(rng, depth - 1)
                kids.append(kid)
    return (tag, attrs, gone, kids)


def _source(rng, node):
    if isinstance(node, str):
        return node + " "
    tag, attrs, _, kids = node
    inner = "".join(_source(rng, k) for k in kids)
    return f"<{tag}{attrs}>{inner}" + ("" if tag == "li" and rng.random() < 0.5 else f"</{tag}>")


def _plain_lines(node, lines):
    """The plain renderer: words of a block stand on lines of their own."""
    if isinstance(node, str):
        lines[-1].append(node)
        return
    tag, _, gone, kids = node
    if gone:
        return
    block = tag not in ("b", "span")
    if block:
        lines.append([])
    for k in kids:
        _plain_lines(k, lines)
    if block:
        lines.append([])


@pytest.mark.parametrize("seed", range(60))
def test_html_against_a_plain_renderer(seed):
    import random

    rng = random.Random(seed)
    trees = [_tree(rng, 4) for _ in range(4)]
    lines = [[]]
    for t in trees:
        _plain_lines(t, lines)
    got = html.text_of("".join(_source(rng, t) for t in trees))
    assert [[w for w in line.split() if w != "-"] for line in got.split("\n") if line.strip()] == [x for x in lines if x]


def test_html_table(spark):
    pages = spark.createDataFrame([(1, None), (2, "<p>x"), (2, "<p>x")], "page_id long, html string").withColumn("text", F.lit(0))
    assert [tuple(r) for r in html.extract(pages).orderBy("page_id").collect()] == [(1, "", 0, 0), (2, "x", 1, 1), (2, "x", 1, 1)]
    assert html.extract(pages.limit(0)).count() == 0
