"""Document fingerprints by Order MinHash, in DataFrame and SQL functions only.

A text is cut into words (long ones into pieces), each run of `K` of them is a k-mer,
and equal k-mers of a text are told apart by their occurrence number. Each of `M` hash
functions selects the two k-mers of least hash; they are put in the order that they have
in the text and hashed together. Two texts agree in a place of the fingerprint if they
have the same least k-mers in the same order there, so the share of equal places falls
both when content changes and when it moves.

The hash functions are rotations of one 40-bit hash, h_j(x) = h(x) - r_j modulo 2^40,
each of which orders a text's k-mers as a random function does. All selections then come
from one sort of a text's k-mers: the least two under h_j are those that follow r_j.

Cases: null counts as the empty text. A text without words has a fixed fingerprint that
equals that of another such text only. Fewer words than `K` form one k-mer. Work and
memory are linear in a text's length but for the sort. Beyond 16,777,214 words of a text
positions tie, in a defined order. Columns beside doc_id and text are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.frames import partitions

K, M, PIECE = 2, 64, 12
RANGE_CHARS, MOST_RANGES = 64_000_000, 2_000
_POS = (1 << 24) - 1
_PROBES = "transform(sequence(0, {m} - 1), j -> shiftleft(CAST(j AS BIGINT) - {half}, {shift}) | {pos})"


def fingerprinted(frame: DataFrame, text: str, out: str, k: int = K, m: int = M) -> DataFrame:
    """The frame with column `out`: an array of m longs, each below 2^32."""
    if m & (m - 1) or not 2 <= m <= 1024:
        raise ValueError("m is a power of two up to 1024")
    gram = ", ".join(f"__w[i + {d}]" for d in range(k))
    probes = _PROBES.format(m=m, half=m // 2, shift=64 - (m - 1).bit_length(), pos=_POS)
    steps = {
        "__w": f"regexp_extract_all(coalesce({text}, ''), '[^\\\\x20\\\\x09-\\\\x0D]{{1,{PIECE}}}', 0)",
        # Hash in the upper 40 bits, position in the lower 24.
        "__p": f"""CASE WHEN size(__w) = 0 THEN CAST(array() AS ARRAY<BIGINT>)
                   WHEN size(__w) < {k} THEN array(xxhash64(__w) & {~_POS}L)
                   ELSE sort_array(transform(sequence(0, size(__w) - {k}), i -> (xxhash64({gram}) & {~_POS}L) | least(i, {_POS - 1}))) END""",
        "__runs": "CASE WHEN size(__p) = 0 THEN array() ELSE filter(sequence(0, size(__p) - 1), i -> i = 0 OR shiftright(__p[i], 24) <> shiftright(__p[i - 1], 24)) END",
        # Where k-mers repeat, their occurrence number enters the hash.
        "__nth": "CASE WHEN size(__runs) < size(__p) THEN flatten(transform(sequence(0, size(__runs) - 1), j -> sequence(0, coalesce(get(__runs, j + 1), size(__p)) - __runs[j] - 1))) END",
        "__q": f"""CASE WHEN __nth IS NULL THEN __p
                   ELSE sort_array(transform(__p, (x, i) -> if(__nth[i] = 0, x, (xxhash64(shiftright(x, 24), __nth[i]) & {~_POS}L) | (x & {_POS})))) END""",
        "__a": f"sort_array(concat(__q, {probes}))",
        "__at": f"filter(sequence(0, size(__a) - 1), i -> (__a[i] & {_POS}) = {_POS})",
        "__pair": "transform(__at, (x, j) -> if(size(__q) = 0, NULL, named_struct('a', __q[(x - j) % size(__q)], 'b', __q[(x - j + 1) % size(__q)])))",
        out: f"""transform(__pair, t -> if(t IS NULL, 0L, 4294967295L & if((t.a & {_POS}) <= (t.b & {_POS}),
                 xxhash64(shiftright(t.a, 24), shiftright(t.b, 24)), xxhash64(shiftright(t.b, 24), shiftright(t.a, 24)))))""",
    }
    for name, sql in steps.items():
        frame = frame.withColumn(name, F.expr(sql))
    return frame.drop(*(c for c in steps if c != out))


def as_text(signature: Column) -> Column:
    """A fingerprint as hexadecimal text, eight digits a place."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal places."""
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"] == p["b"])) / F.size(a)


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with `next_<column>` of the row that follows by (doc_id, text); the first follows the last. Null ids come first.

    Rows are dealt into ranges of doc_id; a range also receives a copy of the row that follows it.
    Only the ranges' bounds pass the driver. There are two ranges for each shuffle partition, or one for each
    `RANGE_CHARS` of text where that is more (up to `MOST_RANGES`; beyond, the partitions decide).
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    chars = rows.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    n = max(2 * partitions(rows.sparkSession), min(MOST_RANGES, chars // RANGE_CHARS))
    cuts = rows.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 20 * n).alias("c")).collect()[0].c
    cuts = sorted(set(cuts or []))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= key)) if cuts else F.lit(0)
    firsts = sorted((r.part, r.first) for r in rows.groupBy(part.alias("part")).agg(F.min(key).alias("first")).collect())
    if not firsts:
        firsts = [(0, 0)]
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}
    ahead = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[key]
    places = F.array_compact(F.array(F.struct(part.alias("part"), F.lit(0).alias("copy")), F.when(F.array_contains(F.array(*map(F.lit, before)), key), F.struct(ahead.alias("part"), F.lit(1).alias("copy")))))
    dealt = rows.withColumn("__key", key).withColumn("__place", F.explode(places))
    order = Window.partitionBy("__place.part").orderBy("__place.copy", "__key", "text")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter("__place.copy = 0").drop("__key", "__place")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness; see the contract of op2."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(fingerprinted(slim, "text", "sig"), ["text", "sig"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    rows = fingerprinted(rows, "edited", "edited_sig")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
