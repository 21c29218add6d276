"""Phrase collocation mining with exact counts.

Texts are cut into pieces at punctuation and line ends, and identical pieces of a language
become one with a multiplicity, so what is copied is counted once. Phrases of 1 to
`most_words` words are then counted level by level. Each task adds up its pieces' weighted
phrases in a small table and hands them, packed, to hash buckets; each bucket is counted
out-of-core in DuckDB (bounded memory, the task's own scratch folder), and phrases below the least
count are left there. They can be left: a phrase that occurs often enough has parts that do. For the
same reason a level only emits phrases whose two shorter parts are marked in a bitmap of
fixed size built from the level before; a false mark costs a row, never a result, and a
full bitmap only saves nothing.

A candidate's parts lie in other buckets than it does. Each cut sends two lookup
requests (part, candidate), which are shuffled to the part's count and back to the candidate.
Scores are exact: products are decimals of 38 digits. What a longer candidate holds is found
by sending each candidate's inner phrases with its count, of which the largest is kept.

Cases: a null text is empty, a null language `und`. Pieces without words count
nothing. Repeated rows count again. Texts and pieces of any length are read whole. Ties
follow the order of UTF-8 bytes. Columns beside the text and the language are left out.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.frames import let_go, lower_ascii, partitions, saved, shared_folder
from wayfold.llm.jaccard import mixed

MOST_WORDS, LEAST, PER_LANG, INSIDE = 3, 10, 2000, 50
#: Bits of the bitmap; phrases in a task's table before it is handed on; hash buckets for each shuffle partition; MB of a bucket's DuckDB.
MARK_BITS, TABLE, PER_PARTITION, MEMORY_MB = 26, 400_000, 4, 200


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, times): distinct pieces, words joined by single blanks."""
    cut = F.explode(F.split(F.coalesce("text", F.lit("")), r"[.,;:!?\x0A-\x0D]"))
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), cut.alias("piece"))
    # Most pieces have no capitals, tabs or repeated blanks: a look is cheaper than a rewrite.
    plain = F.when(F.col("piece").rlike(r"[A-Z\x09]|\x20\x20"), F.trim(F.regexp_replace(lower_ascii(F.col("piece")), r"[\x20\x09]+", " "))).otherwise(F.trim("piece"))
    return rows.select("lang", plain.alias("piece")).filter("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("times"))


class _Codes(dict):
    """A 64-bit code of each word met, odd for words and 0 for the line end between pieces; forgets where it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word) | 1 if word != b"\n" else 0
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _places(columns: list[np.ndarray], lang: str, size: int) -> np.ndarray:
    """Bits of the bitmap for phrases whose words' codes are in columns."""
    total = np.full(len(columns[0]), xxhash.xxh3_64_intdigest(lang), np.uint64)
    for k, codes in enumerate(columns):
        total += codes * np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64))
    return (mixed(total) & np.uint64(size - 1)).astype(np.int64)


def marks(counts: DataFrame, n: int) -> np.ndarray:
    """The bitmap of the phrases of n words."""
    size = 1 << MARK_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Codes()
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_lang.setdefault(lang, []).append(phrase)
            for lang, phrases in by_lang.items():
                codes = known.of(b" ".join(phrases).split(b" ")).reshape(-1, n)
                yield pa.RecordBatch.from_arrays([pa.array(_places(list(codes.T), lang, size))], names=["p"])

    places = counts.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInArrow(run, "p long").withColumn("p", F.col("p") + 1)
    parts = places.groupBy(F.expr("bitmap_bucket_number(p)").alias("nth")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()
    whole = np.zeros(size // 8, np.uint8)
    for r in parts:
        part = np.frombuffer(bytes(r.bits), np.uint8)
        whole[(r.nth - 1) * 4096 : (r.nth - 1) * 4096 + len(part)] = part
    return whole


def _phrases(texts: list[bytes], n: int, lang: str, known: _Codes, marked: np.ndarray | None) -> list[bytes]:
    """The phrases of n words of the pieces, those left out that a phrase of n - 1 words rules out. A line end stands between pieces."""
    if marked is None:
        return b" ".join(texts).split(b" ")
    words = b" \n ".join(texts).split(b" ")
    codes, count = known.of(words), len(words) - n + 2
    if count < 2:
        return []
    columns = [codes[k : k + count] for k in range(n - 1)]
    at = _places(columns, lang, 8 * len(marked))
    ok = ((marked[at >> 3] >> (at & 7)) & 1).astype(bool)
    for c in columns:
        ok &= c != 0
    starts = np.flatnonzero(ok[:-1] & ok[1:]).tolist()
    if n == 2:
        return [words[k] + b" " + words[k + 1] for k in starts]
    return [b" ".join(words[k : k + n]) for k in starts]


_BLOCK = pa.schema([("bucket", pa.int32()), ("langs", pa.list_(pa.string())), ("lines", pa.list_(pa.int64())), ("bytes", pa.int64()), ("phrases", pa.binary()), ("times", pa.binary())])


def _packed(tables: dict[str, Counter], buckets: int) -> pa.RecordBatch:
    """One row for each hash bucket: its phrases, a line each, language by language, and their weights."""
    parts: dict[int, list[tuple[str, int, bytes, bytes]]] = {}
    for lang, table in tables.items():
        place = np.fromiter(map(zlib.crc32, table), np.int64, len(table)) % buckets
        phrases, times = np.array([*table, None], object)[:-1], np.fromiter(table.values(), np.int64, len(table))
        order = np.argsort(place, kind="stable")
        cuts = [*np.flatnonzero(np.diff(place[order], prepend=-1)).tolist(), len(order)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            some = order[a:b]
            parts.setdefault(int(place[some[0]]), []).append((lang, b - a, b"\n".join(phrases[some]) + b"\n", times[some].tobytes()))
    rows = []
    for bucket, found in parts.items():
        langs, lines, texts, weights = zip(*found, strict=True)
        text = b"".join(texts)
        rows.append({"bucket": bucket, "langs": langs, "lines": lines, "bytes": len(text), "phrases": pa.compress(text, "zstd", asbytes=True), "times": pa.compress(b"".join(weights), "zstd", asbytes=True)})
    return pa.RecordBatch.from_pylist(rows, _BLOCK)


def weighted(texts: DataFrame, n: int, marked: np.ndarray | None, buckets: int) -> DataFrame:
    """Blocks of weighted phrases of n words of the pieces: (bucket, langs, lines, bytes, phrases, times)."""
    held = texts.sparkSession.sparkContext.broadcast(marked) if marked is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, Counter] = {}
        known = _Codes()
        for batch in batches:
            alike: dict[tuple[str, int], list[bytes]] = {}
            for lang, piece, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                alike.setdefault((lang, times), []).append(piece)
            for (lang, times), some in alike.items():
                made, table = _phrases(some, n, lang, known, held.value if held else None), tables.setdefault(lang, Counter())
                if times == 1:
                    table.update(made)
                else:
                    for phrase, c in Counter(made).items():
                        table[phrase] += c * times
            if sum(map(len, tables.values())) > TABLE:
                yield _packed(tables, buckets)
                tables.clear()
        yield _packed(tables, buckets)
        tables.clear()
        known.clear()
        let_go()

    long = texts.filter(F.col("piece").like("% " * (n - 1) + "%")) if n > 1 else texts  # of n words at least
    slim = long.select("lang", F.col("piece").cast("binary").alias("piece"), "times")
    return slim.mapInArrow(run, "bucket int, langs array<string>, lines array<long>, bytes long, phrases binary, times binary")


def counted(blocks: DataFrame, least: int, memory_mb: int = MEMORY_MB) -> DataFrame:
    """(lang, phrase, f): the phrases of all blocks that occur `least` times, each hash bucket counted in DuckDB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = tempfile.mkdtemp(prefix="phrases-")
        db = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": scratch, "preserve_insertion_order": False})
        now, waiting, codes = None, [], {}

        def load() -> None:
            if waiting:
                block = pa.concat_tables(waiting)  # noqa: F841  read by name below
                db.execute("INSERT INTO held FROM block")
                waiting.clear()

        def counts() -> Iterator[pa.RecordBatch]:
            load()
            langs = pa.array(list(codes), pa.string())
            for part in db.sql("SELECT lang, phrase, sum(times)::BIGINT AS f FROM held GROUP BY lang, phrase HAVING f >= $least", params={"least": least}).to_arrow_reader(100_000):
                yield pa.RecordBatch.from_arrays([langs.take(part.column(0)), part.column(1), part.column(2)], names=["lang", "phrase", "f"])

        try:
            for batch in batches:
                for bucket, langs, lines, size, phrases, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if bucket != now:
                        if now is not None:
                            yield from counts()
                        db.execute("CREATE OR REPLACE TABLE held (lang INTEGER, phrase BLOB, times BIGINT)")
                        now, codes = bucket, {}
                    n = sum(lines)
                    raw = pa.decompress(phrases, size, "zstd")
                    ends = np.append(0, np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1).astype(np.int32)  # a phrase ends with its line end
                    own = np.repeat(np.array([codes.setdefault(x, len(codes)) for x in langs], np.int32), lines)
                    weights = np.frombuffer(pa.decompress(times, 8 * n, "zstd"), np.int64)
                    waiting.append(pa.table({"lang": own, "phrase": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), raw]), "times": weights}))
                    if sum(w.num_rows for w in waiting) > 200_000:
                        load()
            if now is not None:
                yield from counts()
        finally:
            db.close()
            shutil.rmtree(scratch, ignore_errors=True)
            let_go()

    dealt = blocks.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, "lang string, phrase binary, f long")
    return dealt.select("lang", F.rtrim(F.col("phrase").cast("string"), F.lit("\n")).alias("phrase"), "f")


def phrase_counts(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases that occur `least` times, and (lang, n) of all words."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
    pieces(docs).write.parquet(f"{folder}/pieces")
    texts = spark.read.parquet(f"{folder}/pieces")
    words = F.col("times") * (F.length("piece") - F.length(F.replace("piece", F.lit(" "))) + 1)
    totals = saved(texts.groupBy("lang").agg(F.sum(words).alias("n")))
    buckets, marked = PER_PARTITION * partitions(spark), None
    for n in range(1, most_words + 1):
        counted(weighted(texts, n, marked, buckets), least).write.parquet(f"{folder}/counts/words={n}")
        if n < most_words:
            marked = marks(spark.read.schema("lang string, phrase string, f long").parquet(f"{folder}/counts/words={n}"), n)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/pieces")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.read.schema("lang string, phrase string, f long, words int").parquet(f"{folder}/counts"), totals


def _span(words: str, start: str, length: str) -> str:
    return f"array_join(slice({words}, {start}, {length}), ' ')"


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each candidate, by its lowest-scoring cut."""
    candidates = counts.filter("words > 1").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    sides = F.explode(F.expr(f"array(named_struct('side', 'l', 'part', {_span('w', '1', 'k')}), named_struct('side', 'r', 'part', {_span('w', 'k + 1', 'words - k')}))"))
    requests = cuts.select("lang", "phrase", "a", "k", sides.alias("s")).select("lang", "phrase", "a", "k", "s.*")
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    side = lambda x: F.max(F.when(F.col("side") == x, F.col("f"))).alias(x)
    both = answers.groupBy("lang", "phrase", "a", "k").agg(side("l"), side("r"))
    wide = both.withColumn("score", F.expr("(1000000 * cast(a AS decimal(19,0)) * cast(a AS decimal(19,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"))
    best = wide.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def outer_counts(counts: DataFrame) -> DataFrame:
    """(lang, phrase, outer): for phrases inside longer candidates the largest count of these."""
    longer = counts.filter("words > 2").withColumn("w", F.split("phrase", " "))
    inner = F.expr(f"flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> {_span('w', 'i', 'n')})))")
    return longer.select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("outer"))


def mine(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, per_lang: int = PER_LANG, inside: int = INSIDE) -> DataFrame:
    """Each language's `per_lang` best phrases: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = phrase_counts(docs, most_words, least)
    kept = scored(counts).join(outer_counts(counts), ["lang", "phrase"], "left").filter(f"outer IS NULL OR 100 * outer < {inside} * a")
    order = (F.desc("score"), F.desc("a"), "phrase")
    # A language's candidates are cut to the best of each part first, so its last task sorts a bounded number whatever the corpus.
    parts = kept.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))))
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).filter(F.col("rank") <= per_lang).drop("__part")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= per_lang)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
