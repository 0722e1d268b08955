"""Toxicity by a factorization machine over hashed terms.

A text is the set of its distinct terms (lower-case words, as 64-bit hashes). Of the terms of the fitted rows those that
tell most about the label are kept; the machine has a weight and a short vector for each, and the product of two
vectors is the weight of the pair, so an insult beside a group mention may count for more than both alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libraryloom.llm.common import held_out, joined, prefix_sums, runs_by_size, slices, span_hash, utf8_of, word_spans
from libraryloom.llm.labelled import FIT_ROWS, Adam, sigmoid, training_rows

TERMS = 1024
FACTORS = 4
THRESHOLD = 0.5
STEPS = 4000
#: Terms under this chi-squared, the terms that say little alone, are held near zero unless pairs of them tell more.
CLEAR = 20.0

_inside = np.zeros(256, dtype=bool)
_inside[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every word of the texts: runs of ASCII letters, digits and bytes over 127, lower-case."""
    b, at = joined(texts)
    b = _lower[b]
    start, end = word_spans(b, _inside)
    return np.searchsorted(at, start, side="right") - 1, span_hash(prefix_sums(b), start, end)


@dataclass
class Machine:
    keys: np.ndarray  # sorted hashes of the terms
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def pairs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in ``keys``) of each distinct known term of each text."""
        row, term = terms(texts)
        if not len(self.keys):
            return row[:0], row[:0]
        at = np.minimum(np.searchsorted(self.keys, term), len(self.keys) - 1)
        hit = self.keys[at] == term
        both = np.unique(row[hit] * len(self.keys) + at[hit])
        return both // len(self.keys), both % len(self.keys)

    def score(self, texts: list[bytes]) -> np.ndarray:
        row, term = self.pairs(texts)
        n = len(texts)
        total = self.bias + np.bincount(row, self.linear[term], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            total += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return sigmoid(total)


def fit(texts: list[bytes], y: np.ndarray, most: int = TERMS, factors: int = FACTORS, steps: int = STEPS, seed: int = 7) -> Machine:
    """Fit a machine to texts and labels 0 or 1. Without both labels the score is the smoothed share of label 1."""
    n = len(texts)
    prior = (y.sum() + 0.5) / (n + 1)
    empty = Machine(np.zeros(0, np.uint64), float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, factors)))
    if not 0 < y.sum() < n:
        return empty
    seen = []
    for i, j in runs_by_size([len(t) for t in texts], 2_000_000):
        row, term = terms(texts[i:j])
        by = np.lexsort((term, row))
        row, term = row[by], term[by]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])]) if len(row) else np.zeros(0, bool)
        seen.append((row[new] + i, term[new]))
    row, term = (np.concatenate(x) for x in zip(*seen, strict=True))
    keys, place, count = np.unique(term, return_inverse=True, return_counts=True)
    positive = np.bincount(place, y[row], len(keys))
    p, q = (positive + 0.5) / (y.sum() + 1), (count - positive + 0.5) / (n - y.sum() + 1)
    gain = (p - q) ** 2 / (count / n * (1 - count / (n + 1)) * (1 / y.sum() + 1 / (n - y.sum())))  # chi-squared of the term alone
    gain[count < 3] = -1
    best = np.sort(np.argsort(-gain, kind="stable")[:most])
    best = best[gain[best] > 0]
    if not len(best):
        return empty
    held = np.where(gain[best] >= CLEAR, 1e-5, 1e-2)
    new = np.full(len(keys), -1)
    new[best] = np.arange(len(best))
    keep = new[place] >= 0
    row, place = row[keep], new[place[keep]]
    ends = np.searchsorted(row, np.arange(n + 1))

    rng = np.random.default_rng(seed)
    bias, linear, vectors = np.array([np.log(prior / (1 - prior))]), np.zeros(len(best)), rng.normal(0, 0.01, (len(best), factors))
    adam = Adam([bias, linear, vectors], 0.05)
    size = max(16, min(256, n // 8))
    for _ in range(-(-steps * size // n)):
        order = rng.permutation(n)
        for at in range(0, n, size):
            part = order[at : at + size]
            length = ends[part + 1] - ends[part]
            r = np.repeat(np.arange(len(part)), length)
            t = place[np.repeat(ends[part] - (np.cumsum(length) - length), length) + np.arange(length.sum())]
            v = vectors[t]
            sums = np.stack([np.bincount(r, v[:, f], len(part)) for f in range(factors)], axis=1)
            squares = np.bincount(r, (v * v).sum(1), len(part))
            out = bias[0] + np.bincount(r, linear[t], len(part)) + 0.5 * ((sums**2).sum(1) - squares)
            slope = (sigmoid(out) - y[part]) / len(part)
            g_linear = np.bincount(t, slope[r], len(best)) + held * linear
            push = slope[r][:, None] * (sums[r] - v)
            g_vectors = np.stack([np.bincount(t, push[:, f], len(best)) for f in range(factors)], axis=1) + (3e-4 + held)[:, None] * vectors
            adam.step([np.array([slope.sum()]), g_linear, g_vectors])
    return Machine(keys[best], float(bias[0]), linear, vectors)


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    A null or empty text has the score of a text without known terms; texts of any length are scored whole. Repeated rows score alike; a null doc_id is never
    held out nor fitted on.
    """
    texts, y, _ = training_rows(spark, docs, labels, label, fit_rows)
    model = spark.sparkContext.broadcast(fit(texts, y))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            score = [model.value.score(utf8_of(texts.slice(i, j - i))) for i, j in slices(texts, 1_000_000)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(score) if score else np.zeros(0))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that score under THRESHOLD, with all their columns; texts are never changed."""
    texts, y, _ = training_rows(spark, docs, labels, label, fit_rows)
    model = spark.sparkContext.broadcast(fit(texts, y))
    place = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            for i, j in slices(texts, 1_000_000):
                yield batch.slice(i, j - i).filter(pa.array(model.value.score(utf8_of(texts.slice(i, j - i))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
