"""Toxicity by weak supervision.

Voters: words of a small fixed lexicon, patterns (direct insults, masked words), and
lexicon and stem voters mined from the labelled rows that may be learnt from: words and
word stems whose share in toxic rows is far above that in others. A voter says "toxic"
where it matches and abstains elsewhere; a last voter says "clean" where no other speaks.

Label model: a generative model p(label, votes) with one rate per voter and label and
correlations for voters that go together beyond what the label explains. It is fitted by
expectation and maximisation over the votes of the sample; a row's noisy label is one
more voter there. Correlated voters share one weight: their log-odds are divided by
their summed correlations. The model gives each row a posterior label.

Classifier: logistic regression on hashed words and word stems, fitted to the posterior
labels (and so not bound to the voters' own words), then applied to every whole text.

Bounds: at most `SAMPLE` labelled rows (those of least hash) are used for fitting; their
votes and hashed features, at most `PER_ROW` each, pass the driver. No label, language,
source or id is an input of a score.

Cases: null counts as the empty text, which scores by the bias alone. With no toxic or
no clean label to learn from, every score is the share of toxic labels (or 0). Repeated
rows score alike. Texts of any length are read whole, by distinct words. Extra columns
are left out.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.frames import let_go, remainder, text_batches

SAMPLE, PER_ROW, BUCKETS, STEMS = 6000, 2000, 1 << 20, (4, 5, 6, 7)
HELD_OUT, MOD = 0, 5
# Insults in the four languages that the corpus holds.
LEXICON = (
    "idiot idiots moron morons stupid dumb loser losers trash pathetic worthless disgusting scum clown imbecile "
    "dummkopf trottel arschloch abschaum wertlos idioten blödmann "
    "imbécile crétin connard ordure minable débile salaud "
    "imbécil estúpido estúpida basura inútil asqueroso escoria gilipollas"
).split()
_WORD = re.compile(r"[^\W_]+(?:[*@$!#0-9]+[^\W_]+)?")
_DIRECT = re.compile(r"\b(?:you|du|tu|vous|ihr)\b[^.!?\n]{0,20}\b(?:are|bist|seid|es|êtes|eres)\b[^.!?\n]{0,20}\b(?:idiot|moron|stupid|loser|trash|scum|clown)", re.IGNORECASE)
_MASKED = re.compile(r"\b(?:[a-z]{1,4}[*@$#]{1,4}[a-z]{1,4})\b", re.IGNORECASE)


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def stems_of(word: str) -> list[str]:
    """The beginnings of a longer word."""
    return [word[:n] for n in STEMS if len(word) > n]


def bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def features(found: set[str]) -> set[int]:
    """Hashed words and stems of a text."""
    return {bucket("w" + w) for w in found} | {bucket("s" + s) for w in found for s in stems_of(w)}


@dataclass
class LabelModel:
    """Rates of each voter under either label, the class balance, and the correlated groups' sizes."""

    balance: float
    rates: np.ndarray  # voters x 2: P(votes | clean), P(votes | toxic)
    share: np.ndarray  # 1 / size of the voter's correlated group

    def odds(self, votes: np.ndarray) -> np.ndarray:
        """Log-odds of each row, correlated voters counting as one."""
        log = np.log(self.rates)
        no = np.log1p(-self.rates)
        return np.log(self.balance / (1 - self.balance)) + (votes * (log[:, 1] - log[:, 0]) * self.share).sum(1) + ((1 - votes) * (no[:, 1] - no[:, 0]) * self.share).sum(1)


def fit_label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 20, trust: float = 0.97) -> tuple[LabelModel, np.ndarray]:
    """The model and each row's posterior, by expectation and maximisation.

    A row's noisy label is one more voter of known accuracy `trust`; the model's own voters get theirs estimated.
    """
    n, voters = votes.shape
    post = np.where(labels == 1, trust, 1 - trust)
    prior = np.log(trust / (1 - trust)) * (2 * labels - 1)
    model = LabelModel(0.5, np.full((voters, 2), 0.5), np.ones(voters))
    for k in range(rounds):
        mass = np.array([(1 - post).sum(), post.sum()]) + 1e-9
        hits = np.stack([((1 - post)[:, None] * votes).sum(0), (post[:, None] * votes).sum(0)], 1)
        rates = np.clip((hits + 0.05) / (mass + 1.0), 1e-5, 1 - 1e-5)
        balance, share = float(np.clip(post.mean(), 0.01, 0.99)), model.share
        if k == 1:  # dependence that the label leaves: correlated residuals
            rest = votes - post[:, None] * rates[:, 1] - (1 - post)[:, None] * rates[:, 0]
            scale = np.sqrt((rest**2).mean(0)) + 1e-9
            corr = (rest.T @ rest) / n / scale / scale[:, None]
            np.fill_diagonal(corr, 0)
            share = 1 / (1 + np.where(corr > 0.2, corr, 0).sum(1))
        model = LabelModel(balance, rates, share)
        odds = np.clip(model.odds(votes) * 0.5, -4, 4) + prior
        post = 1 / (1 + np.exp(-odds))
    return model, post


@dataclass
class Classifier:
    """Logistic regression over hashed features, scaled by a text's number of features."""

    weights: np.ndarray
    bias: float

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        flat = self.weights[np.concatenate(rows)] if sizes.sum() else np.zeros(0)
        total = np.zeros(len(rows))
        some = sizes > 0
        if some.any():
            starts = np.cumsum(sizes) - sizes
            total[some] = np.add.reduceat(flat, starts[some])
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -40, 40)))


def fit_classifier(rows: list[np.ndarray], target: np.ndarray, rounds: int = 200, rate: float = 0.1, ridge: float = 0.2, common: float = 0.05) -> Classifier:
    """Accelerated gradient descent on the ridge-penalised loss, over features that tell the labels apart; the value of common ones falls with their frequency."""
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if sizes.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    used, col = np.unique(flat, return_inverse=True)
    df = np.bincount(col, minlength=len(used))
    excess = np.bincount(col, target[owner], len(used)) - df * target.mean()
    telling = (df >= 2) & (np.abs(excess) >= 2 * np.sqrt(df * target.mean()))
    keep = telling[col]
    owner, (used_kept, col) = owner[keep], np.unique(col[keep], return_inverse=True)
    used, df = used[used_kept], df[used_kept]
    value = np.minimum(1.0, common * len(rows) / df)
    x = value[col]
    weight, bias = np.zeros(len(used)), float(np.log(target.mean() / (1 - target.mean())))
    first, second = np.zeros(len(used)), np.zeros(len(used))
    bias_first = bias_second = 0.0
    for k in range(1, rounds + 1):
        error = 1 / (1 + np.exp(-np.clip(np.bincount(owner, x * weight[col], len(rows)) + bias, -40, 40))) - target
        slope = np.bincount(col, error[owner] * x, len(used)) + ridge * weight
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weight -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1.0)
        bias_first, bias_second = 0.9 * bias_first + 0.1 * error.sum(), 0.99 * bias_second + 0.01 * error.sum() ** 2
        bias -= rate * (bias_first / (1 - 0.9**k)) / (np.sqrt(bias_second / (1 - 0.99**k)) + 1.0)
    whole = np.zeros(BUCKETS)
    whole[used] = weight * value
    return Classifier(whole, bias)


def mine(found: list[set[str]], labels: np.ndarray, least: int = 3, most: int = 400) -> tuple[list[str], list[str]]:
    """Words and stems of far higher share in toxic rows: each becomes a voter."""
    toxic, clean = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    out = []
    for stems in (False, True):
        parts = (lambda row: {s for w in row for s in stems_of(w)}) if stems else (lambda row: row)
        hits = Counter(w for row, y in zip(found, labels, strict=True) if y for w in parts(row))
        hits = {w: n for w, n in hits.items() if n >= least}
        misses = Counter(w for row, y in zip(found, labels, strict=True) if not y for w in parts(row) if w in hits)
        lift = {w: (n / toxic) / ((misses[w] + 0.5) / clean) for w, n in hits.items()}
        out.append(sorted(sorted((w for w in lift if lift[w] >= 12), key=lambda w: (-lift[w] * hits[w], w))[:most]))
    return out[0], out[1]


def votes(found: list[set[str]], texts: list[str], lexicon: list[str], stems: list[str]) -> np.ndarray:
    """Rows x voters of 0 and 1."""
    place = {w: k for k, w in enumerate(lexicon)}
    stem_place = {w: len(lexicon) + k for k, w in enumerate(stems)}
    base = len(lexicon) + len(stems)
    out = np.zeros((len(found), base + 3), np.float32)
    for r, (row, text) in enumerate(zip(found, texts, strict=True)):
        for w in row:
            if (k := place.get(w)) is not None:
                out[r, k] = 1
            for s in stems_of(w):
                if (k := stem_place.get(s)) is not None:
                    out[r, k] = 1
        out[r, base] = bool(_DIRECT.search(text))
        out[r, base + 1] = bool(_MASKED.search(text))
        out[r, base + 2] = not out[r, :base].any()
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """The classifier, from at most `sample` labelled rows outside the held-out fold."""
    allowed = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), MOD) != HELD_OUT))
    # Where labels of a document differ, one "toxic" decides.
    chosen = allowed.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, marks = [], []
            for text in batch.column(2).to_pylist():
                # Rows of more distinct words are represented by those of least hash; only fitting sees this.
                found = sorted(words(text), key=lambda w: xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")))[:PER_ROW]
                rows.append("\n".join(found))
                marks.append((" you are stupid" if _DIRECT.search(text or "") else "") + (" x*x" if _MASKED.search(text or "") else ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.string()), pa.array(marks, pa.string())], names=["doc_id", "toxic", "found", "marks"])

    texts = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    rows = texts.mapInArrow(distinct_words, "doc_id long, toxic int, found string, marks string").toPandas().sort_values(["doc_id", "found"])
    known = rows["toxic"].to_numpy(float)
    if not len(known) or known.min() == known.max():
        share = float(known.mean()) if len(known) else 0.0
        return Classifier(np.zeros(BUCKETS), 40.0 if share == 1 else -40.0)
    found = [set(map(sys.intern, f.split("\n"))) - {""} for f in rows["found"]]
    marks = rows["marks"].tolist()
    del rows
    lexicon, stems = mine(found, known)
    lexicon = sorted(set(lexicon) | set(LEXICON))
    matrix = votes(found, marks, lexicon, stems)
    _, posterior = fit_label_model(matrix, known)
    return fit_classifier([np.fromiter(sorted(features(f)), np.int32) for f in found], np.clip(posterior, 0.001, 0.999))


SCHEMA = "doc_id long, score double"


class _Known(dict):
    """The features of words met, as far as they have a weight; bounded."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = tuple(f for f in features({word}) if self.weights[f])
        return got


def found_features(text: str | None, known: _Known) -> np.ndarray:
    """The weighted features of a text."""
    return np.fromiter({f for part in filter(None, map(known.__getitem__, words(text))) for f in part}, np.int64)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        own, known = Classifier(weights, bias), _Known(weights)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                rows.append(found_features(text, known))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(rows) if rows else np.zeros(0))], names=["doc_id", "score"])
        known.clear()
        let_go()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below one half, with all their columns."""
    model = fit(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        own, known = Classifier(weights, bias), _Known(weights)
        for batch in batches:
            if batch.num_rows:
                rows = [found_features(text, known) for text in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(own.score(rows) < 0.5))
        known.clear()
        let_go()

    return text_batches(docs).mapInArrow(run, docs.schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    got = score(docs, fit(docs, labels))
    return got.select("doc_id", (remainder(F.col("doc_id"), MOD) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
