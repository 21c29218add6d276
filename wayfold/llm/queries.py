"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import ann, bpe, colloc, html, jaccard, lines, lm, mix, ordermin, pii, resample, simhash, toxicity
from wayfold.session import saved, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.compare_edited(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", lines.host_of(F.col("url")).alias("host"), lines.lines_of_html(F.col("html")).alias("text"))
    return lines.dedup(saved(pages), F.col("host")).withColumns({n: F.col(n).cast("long") for n in ("n_lines", "n_dropped")})


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.taken_by_document(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colloc.mine(table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_order_minhash": op2_order_minhash,
    "op3_ann": op3_ann,
    "op4_pii": op4_pii,
    "op5_lines": op5_lines,
    "op6_lm": op6_lm,
    "op7_jaccard": op7_jaccard,
    "op8_mix": op8_mix,
    "op9_bpe": op9_bpe,
    "op10_html": op10_html,
    "op11_resample": op11_resample,
    "op12_collocations": op12_collocations,
    "op13_simhash": op13_simhash,
}
_OP5 = r"""
WITH bare AS (
    SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host, regexp_replace(html,
        '(?is)<(?:!--(?:.*?-->|.*)|(?:script|style|noscript|template|head)(?:\s[^>]*)?(?:>(?:.*?</(?:script|style|noscript|template|head)\s*>|.*)|\z))', '', 'g') AS text
    FROM pages
),
tagged AS (SELECT *, regexp_extract(text, '(?s)^.*>', 0) AS tags FROM bare),
texts AS (
    SELECT page_id, host, regexp_replace(regexp_replace(tags,
        '(?i)</?(?:p|div|li|ul|ol|br|tr|table|h[1-6]|section|article|header|footer|nav|aside|main|blockquote|pre|td|th|dd|dt|dl|form|hr|body|html)(?:\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g') || substr(text, length(tags) + 1) AS text
    FROM tagged
),
parted AS (SELECT *, string_split(text, chr(10)) AS ls, row_number() OVER () AS r FROM texts),
seen AS (SELECT DISTINCT r, host, trim(l) AS line FROM (SELECT r, host, unnest(ls) AS l FROM parted) WHERE trim(l) <> ''),
totals AS (SELECT host, count(*) AS pages FROM texts GROUP BY host),
often AS (
    SELECT c.host, c.line FROM (SELECT host, line, count(*) AS n FROM seen GROUP BY host, line) c
    JOIN totals t ON c.host IS NOT DISTINCT FROM t.host WHERE n > 1 AND n > 0.05 * pages
),
drops AS (SELECT host, list(line) AS gone FROM often GROUP BY host),
kept AS (
    SELECT p.page_id, p.host, p.text, p.ls, CASE WHEN d.gone IS NULL THEN p.ls ELSE list_filter(p.ls, lambda l: trim(l) = '' OR NOT list_contains(d.gone, trim(l))) END AS keep
    FROM parted p LEFT JOIN drops d ON p.host IS NOT DISTINCT FROM d.host
)
SELECT page_id, host, array_to_string(keep, chr(10)) AS text, coalesce(len(ls), 0) AS n_lines, coalesce(len(ls) - len(keep), 0) AS n_dropped FROM kept
"""

_OP7 = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM worded
),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM sets UNION SELECT b.y, r.c FROM reach r JOIN sides b ON b.x = r.doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.c) AS component_id FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s
"""

_OP12 = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
spans AS (
    SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM worded, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size
),
counts AS (SELECT lang, size, phrase, count(*)::BIGINT AS f FROM spans GROUP BY lang, size, phrase HAVING count(*) >= 10),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
parts AS (SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score FROM cuts c
    JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
outers AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, a AS f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE size = 3) GROUP BY lang, phrase),
kept AS (SELECT b.* FROM best b LEFT JOIN outers o USING (lang, phrase) WHERE o.f IS NULL OR 100 * o.f < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op5_lines": _OP5, "op7_jaccard": _OP7, "op12_collocations": _OP12}
