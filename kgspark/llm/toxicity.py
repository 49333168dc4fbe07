"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A sentence's score is the logistic function of a bias and the weights of its words, where a word's weight is the sum
over its features (the word and its prefixes). A document is toxic unless none of its sentences is:
1 - product(1 - sentence score). Training sees document labels only and pushes the blame to sentences; the sentence
of the highest score locates the offence. Scoring takes the background off every sentence's evidence -log(1 - score):
what a sentence of the bias alone, or of BACKGROUND if that is more, has. Plain prose so adds none, however long it is.

The model is fitted on at most SAMPLE labelled documents (those with the smallest hash of their id, so the same ones
in every run); feature counts and the fit use the whole texts of that sample, and every document is scored whole.
Labels, language, source and id never enter a score. Rules for input: null text is empty and scores 0; every row
gives one row with its columns and the new ones; without labels of both kinds no sentence has evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import portions, small_batches

#: Labelled documents that the model is fitted on, at most, and features that get a weight.
SAMPLE, FEATURES = 8000, 2000
THRESHOLD = 0.7
#: Logit of the sentence score (1.8 %) that counts as background, at least.
BACKGROUND = -4.0
PREFIXES = range(3, 8)
#: Documents of the sample that have a feature, at least.
SEEN = 4
STEPS, RATE, DECAY, PRIOR = 400, 0.1, 5e-6, -6.0
#: Words whose weights a task remembers; the memory is emptied when full, which changes no result.
REMEMBERED = 150_000
TOKENS = re.compile(r"[^\W\d_]+|[.!?\n]")
ENDS = frozenset(".!?\n")


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if k < len(word))]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """Feature weights and bias."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.known: dict[str, float] = dict.fromkeys(ENDS, float("nan"))

    def _word(self, word: str) -> float:
        if len(self.known) > REMEMBERED:
            self.known = dict.fromkeys(ENDS, float("nan"))
        weight = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return weight

    def score(self, text: str) -> tuple[float, int, float]:
        """The text's score, its worst sentence (as a number among its stretches between ends) and that one's score."""
        words = TOKENS.findall(text.lower())
        if not words:
            return 0.0, 0, 0.0
        found = list(map(self.known.get, words))
        if None in found:
            found = [self._word(w) if x is None else x for w, x in zip(words, found, strict=True)]
        weights = np.array(found)
        end = np.isnan(weights)
        place = np.cumsum(end)
        logits = np.bincount(place, np.where(end, 0.0, weights), place[-1] + 1)
        full = np.bincount(place[~end], minlength=place[-1] + 1) > 0
        if not full.any():
            return 0.0, 0, 0.0
        # log(1 - score) of every sentence over the background
        clean = np.minimum(0.0, np.logaddexp(0.0, max(self.bias, BACKGROUND)) - np.logaddexp(0.0, logits + self.bias))
        worst = int(np.argmax(np.where(full, logits, -np.inf)))
        return float(-np.expm1(clean[full].sum())), worst, float(-np.expm1(clean[worst]))

    @staticmethod
    def span(text: str, sentence: int) -> tuple[int, int]:
        """Start and end of a stretch between sentence ends, in code points."""
        start = 0
        for k, end in enumerate(re.finditer(r"[.!?\n]|\Z", text)):
            if k == sentence:
                return start, end.end()
            start = end.end()
        return 0, len(text)


def _fit(bags: pa.Table, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the noisy-or likelihood.

    bags holds (toxic, sentences, marked): a document's label, its number of sentences, and the features of those
    that have any; it stays in flat arrays.
    """
    labels = bags.column("toxic").to_numpy().astype(float)
    marked = pa.concat_arrays(bags.column("marked").chunks)
    each_marked = marked.value_lengths().to_numpy()
    inner = marked.flatten()
    sentence = np.repeat(np.arange(len(labels)), each_marked)
    plain = bags.column("sentences").to_numpy().astype(float) - each_marked
    row = np.repeat(np.arange(len(inner)), inner.value_lengths().to_numpy())
    column = inner.flatten().to_numpy()
    theta, first, second = np.append(np.zeros(size), PRIOR), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, theta[column], len(inner)) + theta[-1]
        sigma, sigma0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
        clean = np.bincount(sentence, -np.logaddexp(0, z), len(bags)) - plain * np.logaddexp(0, theta[-1])
        p = np.clip(-np.expm1(clean), 1e-9, 1)
        # d loss / d clean, where loss = -[y log(1 - e^clean) + (1 - y) clean]; d clean / d z = -sigma
        slope = labels * np.exp(clean) / p - (1 - labels)
        each = -slope[sentence] * sigma
        gradient = np.append(np.bincount(column, each[row], size), each.sum() - (slope * plain * sigma0).sum()) / len(bags)
        gradient[:-1] += DECAY * theta[:-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _sentences(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for token in TOKENS.findall(text.lower()):
        if token in ENDS:
            out.append([])
        else:
            out[-1].append(token)
    return [s for s in out if s]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic) that are not held out."""
    # At most SAMPLE rows, so they can be broadcast.
    asked = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE)
    sample = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(asked), "doc_id")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list({f for s in _sentences(t) for w in set(s) for f in features(w)}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(found, pa.list_(pa.string()))], ["toxic", "found"])

    seen = sample.mapInArrow(distinct, "toxic int, found array<string>").select("toxic", F.explode("found").alias("feature"))
    counts = seen.groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    sizes = sample.agg(F.sum("toxic"), F.count("*")).first()
    bad, n = (sizes[0] or 0), sizes[1]
    if not 0 < bad < n:
        return Model({}, PRIOR)
    odds = (F.col("bad") + 0.5) / (bad + 1) / ((F.col("n") - F.col("bad") + 0.5) / (n - bad + 1))
    gain = F.abs(F.log(odds)) * F.sqrt("n")
    top = counts.where(F.col("n") >= SEEN).orderBy(gain.desc(), "feature").limit(FEATURES).select("feature").collect()
    number = {r["feature"]: i for i, r in enumerate(top)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            marked, sizes = [], []
            for text in batch.column("text").to_pylist():
                rows = _sentences(text)
                for word in {w for s in rows for w in s if w not in known}:
                    known[word] = [number[f] for f in features(word) if f in number]
                ids = [[i for w in s for i in known[w]] for s in rows]
                marked.append([x for x in ids if x])
                sizes.append(len(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), pa.array(sizes, pa.int32()), pa.array(marked, pa.list_(pa.list_(pa.int32())))],
                ["doc_id", "toxic", "sentences", "marked"],
            )

    rows = sample.select("doc_id", "toxic", "text").mapInArrow(bags, "doc_id long, toxic int, sentences int, marked array<array<int>>").toArrow()
    weights, bias = _fit(rows.sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("sentences", "ascending")]), len(number))
    return Model({f: float(weights[i]) for f, i in number.items()}, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, and start, end and score of the worst sentence of those that score THRESHOLD or more."""
    new = ["score", "sentence_start", "sentence_end", "sentence_score"]
    rest = [c for c in docs.columns if c not in new]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            rows: list[tuple] = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                total, worst, most = model.score(text)
                rows.append((total, *Model.span(text, worst), most) if total >= THRESHOLD else (total, None, None, None))
            kinds = [pa.float64(), pa.int64(), pa.int64(), pa.float64()]
            made = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *made], [*rest, *new])

    return small_batches(docs).select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, f"{schema}, score double, sentence_start long, sentence_end long, sentence_score double")
