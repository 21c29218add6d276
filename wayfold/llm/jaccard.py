"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles, hashed to 64 bits. A token flips
one position of a very wide parity sketch, so the number of places where two sketches
differ never exceeds the symmetric difference of the sets. Sets of sizes a <= b reach
the similarity s only if that difference is at most (a+b)(1-s)/(1+s). The sketch of a
size band is cut into as many parts as the band's largest set has tokens; a part is
represented by the XOR of the hashes of its positions. A difference breaks at most one
part, so of the D+1 first non-empty parts (in one global order) of two linked documents
at least one must be the same: these D+1 keys are the pigeonhole join. A second, short
sketch (two to four bits a token) then drops candidates by Hamming distance, and the rest are
verified on whole sets.

Nothing is emitted pair by pair within a group. Each key's documents gather around one
pivot, the key's least document; keys of the same documents so fall together. Within a
pivot's documents, in blocks of bounded size, the short sketches choose a spanning
forest of least Hamming distances; its edges are verified and the links contracted into
components. Only what a pivot still holds in different components is then compared
further, and only pairs that the sketches allow leave a block. Keys made of very
frequent tokens come last in the global order (so that a passage which many documents
share is no key of theirs unless they consist of it) and are salted in the pivot step.
The frequent tokens are found over all documents: a token held by the share `HOT` of
all documents is held by that share in one block at least. They steer the work only;
no link depends on them.

Components are contracted by alternating stars over tables in the checkpoint folder.

Cases: a null or wordless text has an empty set, links with nothing and is a component
of its own. Fewer words than a shingle form one shingle. Repeated rows and equal texts
share a set and a component; an id with several texts is as many documents, each with the component of its text. Texts of any length are read whole. Columns beside the
id and the text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.frames import let_go, saved, text_batches

WORDS, SIMILAR = 5, (3, 4)  # similarity as a fraction
SKETCH_BITS, HOT, SMALL, SALTS, BLOCK = 1024, 0.001, 64, 32, 4096
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A word's hash is a polynomial in an odd number over its bytes, A-Z taken as a-z. Sums of
#: a span of words share the powers; a span is short enough for the tables.
_SPAN = 1 << 16
_BYTES = mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(1))
_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_ODD = 0x9E3779B97F4A7C15
_POWERS = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(_SPAN, _ODD, np.uint64))))
_INVERSES = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(_SPAN, pow(_ODD, -1, 1 << 64), np.uint64))))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word of a text, in order."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[codes], prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        at = int(starts[k])
        last = int(np.searchsorted(ends, at + _SPAN, side="right"))
        if last <= k:  # one word longer than a span
            out[k] = xxhash.xxh3_64_intdigest(raw[at : int(ends[k])].lower())
            k += 1
            continue
        stop = int(ends[last - 1])
        sums = np.zeros(stop - at + 1, np.uint64)
        np.cumsum(_BYTES[codes[at:stop]] * _POWERS[: stop - at], out=sums[1:])
        a, b = starts[k:last] - at, ends[k:last] - at
        out[k:last] = (sums[b] - sums[a]) * _INVERSES[a] + (b - a).astype(np.uint64)
        k = last
    return mixed(out)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text, A-Z in lower case."""
    h = word_hashes(text)
    if not len(h):
        return h
    if len(h) < n:
        return mixed(np.array([(sum(int(x) * pow(3, k, 1 << 64) for k, x in enumerate(h)) + len(h)) % (1 << 64)], np.uint64))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _MULTIPLIERS[k % 5]
    total = np.sort(mixed(total))
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def parity(tokens: np.ndarray) -> bytes:
    """The short sketch: bit (token mod size) is the parity of its tokens; the size is a power of two that grows with the set."""
    bits = max(SKETCH_BITS, 1 << (2 * len(tokens)).bit_length())
    counts = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def allowed(a, b, similar: tuple[int, int] = SIMILAR):
    """The largest symmetric difference of linked sets of these sizes."""
    num, den = similar
    return (a + b) * (den - num) // (den + num)


def keys(tokens: np.ndarray, hot: np.ndarray, similar: tuple[int, int] = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """The pigeonhole keys of a set, for each band that a partner may be of, and whether all their tokens are frequent."""
    size = len(tokens)
    num, den = similar
    frequent = np.zeros(size, bool)
    if len(hot) and size:
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        frequent = hot[at] == tokens
    out, hots = [], []
    own = _band(size)
    low = _band(-(-size * num // den))
    for band in range(low, own + 1):
        # Partners are at least as large in the own band, and below the band's end in a lower one.
        most = allowed(size, size * den // num, similar) if band == own else allowed(size, _end(band) - 1, similar)
        if band == 0:  # parts of single tokens
            value, hot_part = tokens, frequent
        else:
            part = tokens >> np.uint64(64 - (_end(band) - 1).bit_length())
            start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            value = np.bitwise_xor.reduceat(mixed(tokens), start) + part[start] * np.uint64(0x9E3779B97F4A7C15)
            hot_part = np.logical_and.reduceat(frequent, start)
            if len(value) <= most:  # fewer parts than the pigeonhole needs: as good as impossible with hashed tokens
                raise AssertionError("a set has too few non-empty parts")
        key = mixed(value ^ np.uint64(band * 0x51ED270B + 1))
        order = np.lexsort((key, hot_part))[: most + 1]
        out.append(key[order])
        hots.append(hot_part[order])
    return np.concatenate(out), np.concatenate(hots)


def _band(size: int) -> int:
    """0: below SMALL; then a band for each doubling."""
    return max(0, size.bit_length() - SMALL.bit_length() + 1)


def _end(band: int) -> int:
    return SMALL << band


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def sets(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, size, digest, sketch) of each document, and (token, size) of frequent tokens with no doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[np.ndarray] = []
        docs_in = tokens_in = 0

        def frequent() -> pa.RecordBatch:
            found, count = np.unique(np.concatenate(block), return_counts=True) if block else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = count >= max(8, HOT * docs_in)
            found, count = found[keep].view(np.int64), count[keep]
            block.clear()
            size = len(found)
            return pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.array(count), pa.nulls(size, pa.binary()), pa.nulls(size, pa.binary()), pa.array(found)], names=names)

        names = ["doc_id", "size", "digest", "sketch", "token"]
        for batch in batches:
            size, digest, sketch = [], [], []
            for text in batch.column(1).to_pylist():
                got = shingles(text, n)
                block.append(got)
                docs_in += 1
                tokens_in += len(got)
                size.append(len(got))
                digest.append(xxhash.xxh3_128_digest(got.tobytes()))
                sketch.append(parity(got))
                if tokens_in > 1_500_000:
                    yield frequent()
                    docs_in = tokens_in = 0
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary()), pa.nulls(len(ids), pa.int64())], names=names)
        yield frequent()
        let_go()

    return docs.mapInArrow(run, "doc_id long, size long, digest binary, sketch binary, token long")


def _features(docs: DataFrame, hot_tokens, n: int, similar: tuple[int, int]) -> DataFrame:
    """(key, salt, doc_id): the pigeonhole keys; a task emits those of a set once. salt is -1 for keys with an infrequent token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, seen = hot_tokens.value, set()
        for batch in batches:
            ids, columns, rows = batch.column(0).to_pylist(), [], 0

            def out(columns: list) -> pa.RecordBatch:
                key, salt, doc = (np.concatenate(c) for c in zip(*columns, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt), pa.array(doc)], names=["key", "salt", "doc_id"])

            for doc, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                tokens = shingles(text, n)
                if doc is None or not len(tokens):
                    continue
                digest = xxhash.xxh3_128_digest(tokens.tobytes())
                if digest in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(digest)
                key, is_hot = keys(tokens, hot, similar)
                salt = np.where(is_hot, xxhash.xxh32_intdigest(digest) % SALTS, -1).astype(np.int32)
                columns.append((key, salt, np.full(len(key), doc, np.int64)))
                rows += len(key)
                if rows > 200_000:
                    yield out(columns)
                    columns, rows = [], 0
            if columns:
                yield out(columns)
        let_go()

    return docs.mapInArrow(run, "key long, salt int, doc_id long")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, similar: tuple[int, int]) -> DataFrame:
    """Of the pairs (a, b) of ids those that link, on whole sets."""
    num, den = similar
    close = pairs
    texts = _only(docs, close.select(F.col("a").alias("doc_id")).union(close.select("b")))
    both = close.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last[0] != y:
                    last = (y, shingles(y, n))
                p, q = shingles(x, n), last[1]
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(common * den >= num * (len(p) + len(q) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return saved(both.mapInArrow(same, "a long, b long"))


def _only(docs: DataFrame, ids: DataFrame, bits: int = 25) -> DataFrame:
    """One row (doc_id, text) for each id given. A bitmap of fixed size keeps most other texts out of the shuffle."""
    ids = ids.distinct()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    parts = ids.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("bits")).collect()
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts:  # buckets are numbered from 1; each holds 32,768 bits
        part = np.frombuffer(bytes(r.bits), np.uint8)
        whole[(r.bucket - 1) * 4096 : (r.bucket - 1) * 4096 + len(part)] = part
    held = docs.sparkSession.sparkContext.broadcast(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).to_numpy()
            yield batch.select(["doc_id", "text"]).filter(pa.array((held.value[p >> 3] >> (p & 7)) & 1 == 1))

    some = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", place.alias("p")).mapInArrow(run, "doc_id long, text string")
    return some.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of the edges (a, b) reaches. Alternating large and small stars."""
    both = lambda e: e.union(e.select("b", "a"))
    now, before = saved(edges.select("a", "b").filter("a <> b").distinct()), None
    while True:
        # Large star: larger neighbours go to the least of a node and its neighbours.
        near = both(now)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        now = near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        down = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        now = saved(down.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _folded(rows: list[bytes], words: int) -> np.ndarray:
    """Sketches as rows of so many 64-bit words, longer ones folded."""
    out = np.empty((len(rows), words), np.uint64)
    for k, r in enumerate(rows):
        x = np.frombuffer(r, np.uint64)
        while len(x) > words:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[k] = x
    return out


def close_pairs(size: np.ndarray, sketches: list[bytes], side: np.ndarray, group: np.ndarray, forest: bool, similar: tuple[int, int] = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose sketches allow a link and whose groups differ; with `forest`, a spanning forest of least distances.

    Where `side` differs at all, only pairs across the sides count.
    """
    num, den = similar
    order = np.argsort(size, kind="stable")
    size, side, group = size[order], side[order], group[order]
    words = np.array([len(sketches[k]) // 8 for k in order])
    both = side.min() != side.max()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n_held = 0
    for w in np.unique(words):
        mine = np.flatnonzero(words == w)
        top = int(np.searchsorted(size, size[mine[-1]] * den // num, side="right"))
        matrix = _folded([sketches[k] for k in order[mine[0] : top]], int(w))
        for i in mine:
            last = int(np.searchsorted(size, size[i] * den // num, side="right"))
            if last <= i + 1:
                continue
            at = np.arange(i + 1, last)
            keep = group[at] != group[i]
            if both:
                keep &= side[at] != side[i]
            at = at[keep]
            if len(at):
                far = np.bitwise_count(matrix[at - mine[0]] ^ matrix[i - mine[0]]).sum(1, dtype=np.int64)
                ok = far <= allowed(size[at], size[i], similar)
                if ok.any():
                    held.append((np.full(int(ok.sum()), i), at[ok], far[ok]))
                    n_held += int(ok.sum())
                    if forest and n_held > 2_000_000:
                        held = [_forest(*map(np.concatenate, zip(*held, strict=True)), group)]
                        n_held = len(held[0][0])
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, far = map(np.concatenate, zip(*held, strict=True))
    if forest:
        i, j, _ = _forest(i, j, far, group)
    return order[i], order[j]


def _forest(i: np.ndarray, j: np.ndarray, far: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of least total distance over the groups."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    kept = []
    a, b = group[i].tolist(), group[j].tolist()
    for k in np.argsort(far, kind="stable").tolist():
        x, y = root(a[k]), root(b[k])
        if x != y:
            above[x] = y
            kept.append(k)
    return i[kept], j[kept], far[kept]


def _candidates(members: DataFrame, slim: DataFrame, of_group: DataFrame | None, forest: bool, similar: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of members of a pivot whose sketches allow a link and whose components differ.

    A pivot's members are cut into blocks of about `BLOCK`; two blocks at a time meet in one
    group of rows, so no task holds more than two blocks of a pivot, and only pairs that
    may link leave it.
    """
    held = members.groupBy("pivot").agg(F.count("*").alias("n")).filter("n > 1")
    rows = members.join(held, "pivot")
    if of_group is not None:
        rows = rows.join(of_group.toDF("rep", "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
        mixed_pivots = rows.groupBy("pivot").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("pivot")
        rows = rows.join(mixed_pivots, "pivot", "left_semi")
    else:
        rows = rows.withColumn("c", F.col("rep"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("pivot", "rep", "c", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    sketched = rows.join(slim.select(F.col("doc_id").alias("rep"), "size", "sketch"), "rep")
    dealt = sketched.repartition("pivot", "lo", "hi").sortWithinPartitions("pivot", "lo", "hi").select("pivot", "lo", "hi", "rep", "c", "own", "size", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def pairs(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            rep, c, own, size = (part.column(k).to_numpy() for k in ("rep", "c", "own", "size"))
            i, j = close_pairs(size, part.column("sketch").to_pylist(), own, c, forest, similar)
            return np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])

        def whole(held: pa.Table) -> pa.RecordBatch:
            names = ("pivot", "lo", "hi")
            keys_ = [held.column(k).to_numpy() for k in names]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys_], axis=0)) + 1
            cuts = [0, *change.tolist(), held.num_rows]
            found = [pairs(held.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
            a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]).combine_chunks() if rest is not None and rest.num_rows else now
            # The last group of a batch may go on in the next one.
            tail = [now.column(k).to_numpy() for k in ("pivot", "lo", "hi")]
            same = np.all([k == k[-1] for k in tail], axis=0)
            cut = int(np.argmax(same))
            if cut:
                yield whole(now.slice(0, cut))
            rest = now.slice(cut)
        if rest is not None and rest.num_rows:
            yield whole(rest)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _shared_ids(docs: DataFrame) -> DataFrame | None:
    """(doc_id, key, own): for each text (by its hash) of an id that has several a number below all ids; None if no id has several."""
    keyed = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("key"))
    several = keyed.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.min(F.col("doc_id")).alias("least")).filter("lo <> hi")
    if several.isEmpty():
        return None
    least = keyed.agg(F.min("doc_id")).collect()[0][0]
    return saved(keyed.join(several, "doc_id", "left_semi").distinct().withColumn("own", F.lit(least) - 1 - F.monotonically_increasing_id()))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document; of an id with several texts each text counts by itself."""
    docs = _texts(docs, id_col, text_col)
    shared = _shared_ids(docs)
    if shared is None:
        return _joined(docs, n, similar)
    return _apart(docs, shared, n, similar).select("doc_id", "n_shingles", "component_id")


def _apart(docs: DataFrame, shared: DataFrame, n: int, similar: tuple[int, int]) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, own, first): `join` where ids have several texts; `first` is the number of the row that stands for its component."""
    marked = docs.withColumn("key", F.xxhash64("text")).join(shared, ["doc_id", "key"], "left").withColumn("own", F.coalesce("own", "doc_id"))
    named = saved(marked.select("doc_id", "key", "own").filter("own IS NOT NULL").distinct())
    found = saved(_joined(marked.select(F.col("own").alias("doc_id"), "text"), n, similar).toDF("own", "n_shingles", "component"))
    rows = found.join(named, "own", "left")
    ids = rows.filter("component IS NOT NULL AND doc_id IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "key", "own")).alias("f")).select("component", F.col("f.doc_id").alias("component_id"), F.col("f.own").alias("first"))
    return rows.join(ids, "component", "left").select("doc_id", "key", "n_shingles", "component_id", "own", "first")


def _joined(docs: DataFrame, n: int, similar: tuple[int, int]) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (doc_id, text) whose ids have one text each."""
    spark = docs.sparkSession
    every = saved(sets(docs, n))
    slim = every.filter("token IS NULL")
    rep = slim.filter("size > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    # HOT bounds the frequent tokens: at most (mean set size / HOT) of them, whatever the number of documents.
    n_docs = slim.count()
    hot = every.filter("token IS NOT NULL").groupBy("token").agg(F.sum("size").alias("n")).filter(F.col("n") >= max(8, HOT * n_docs)).select("token").toPandas()
    hot_tokens = spark.sparkContext.broadcast(np.sort(hot["token"].to_numpy(np.int64).view(np.uint64)))

    by_key = Window.partitionBy("key", "salt")
    features = _features(docs, hot_tokens, n, similar).withColumns({"pivot": F.min("doc_id").over(by_key), "top": F.max("doc_id").over(by_key)})
    rows = saved(features.filter("pivot < top OR salt >= 0").select("key", "salt", "doc_id", "pivot"))
    # A salted key's pivots meet in a second step.
    salted = rows.filter("salt >= 0")
    second = salted.select("key", "pivot").distinct().withColumn("first", F.min("pivot").over(Window.partitionBy("key")))
    around = rows.filter("salt < 0").select("pivot", "doc_id").union(salted.join(second, ["key", "pivot"]).select("first", "doc_id")).distinct()
    of = saved(slim.select("doc_id", "digest").join(rep, "digest").select("doc_id", "rep"))
    members = saved(around.join(of, "doc_id").select("pivot", "rep").distinct())

    near = saved(_candidates(members, slim, None, True, similar))
    links = _verified(near, docs, n, similar)
    # What a pivot holds but lies in different components is compared with each other.
    rest = saved(_candidates(members, slim, components(links), False, similar).join(near, ["a", "b"], "left_anti"))
    final = components(links.union(_verified(rest, docs, n, similar)))
    classes = of.select("rep").distinct().join(final.toDF("rep", "c"), "rep", "left").select("rep", F.coalesce("c", "rep").alias("component_id"))
    known = slim.join(rep, "digest", "left").join(classes, "rep", "left")
    return known.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The documents but those that stand behind another of their component: the least id stays, and of its texts the least hash. Repeated rows of a text and an id stay once.

    Rows without an id stay.
    """
    texts = _texts(docs, "doc_id", "text")
    shared = _shared_ids(texts)
    if shared is None:
        gone = _joined(texts, WORDS, SIMILAR).filter("component_id < doc_id").select(F.col("doc_id").alias("__id")).distinct()
        kept = docs.join(gone, F.col("doc_id") == F.col("__id"), "left_anti")
    else:
        gone = _apart(texts, shared, WORDS, SIMILAR).filter("own <> first").select(F.col("doc_id").alias("__id"), F.col("key").alias("__gone")).distinct()
        kept = docs.join(gone, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__gone")), "left_anti")
    again = kept.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL")
    if again.isEmpty():
        return kept
    numbered = kept.withColumn("__text", F.xxhash64("text"))
    return numbered.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "__text"]).unionByName(numbered.filter("doc_id IS NULL")).drop("__text")
