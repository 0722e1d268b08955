"""Text quality by random-indexing word vectors and a small network.

Every token has a fixed random sparse index vector. A token's word vector is the sum of the index vectors of its
neighbours in the fitted texts, scaled, plus its own index vector. A text is the mean of its tokens' vectors; a network
of two layers scores it, and a temperature fitted on rows that the network did not see calibrates the score. Rare words
stand for their shape (letter case, length, marks around them), so every token of a text takes part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libraryloom.llm.common import held_out, joined, prefix_sums, runs_by_size, span_hash, splitmix, utf8_of, word_spans
from libraryloom.llm.labelled import FIT_ROWS, Adam, sigmoid, training_rows

VOCABULARY = 4096
WIDTH = 64
HIDDEN = 32
WINDOW = 2
THRESHOLD = 0.3
EPOCHS = 60

AGAIN = np.uint64(0xA6A1)

_inside = np.ones(256, dtype=bool)
_inside[[32, *range(9, 14)]] = False
_upper, _lower, _digit, _mark = (np.zeros(256, dtype=np.int64) for _ in range(4))
_upper[65:91] = 1
_lower[97:123] = 1
_lower[128:] = 1
_digit[48:58] = 1
_mark[33:48] = _mark[58:65] = _mark[91:97] = _mark[123:127] = 1


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, hash of shape) of every run of bytes that are not white space."""
    b, at = joined(texts)
    start, end = word_spans(b, _inside)
    row = np.searchsorted(at, start, side="right") - 1
    word = span_hash(prefix_sums(b), start, end)
    again = np.flatnonzero((word[1:] == word[:-1]) & (row[1:] == row[:-1])) + 1
    counts = []
    for kind in (_upper, _lower, _digit, _mark):
        sums = np.concatenate([[0], np.cumsum(kind[b])])
        counts.append(sums[end] - sums[start])
    upper, lower, digit, mark = counts
    shape = np.minimum(upper, 2) + 3 * np.minimum(lower, 1) + 6 * np.minimum(digit, 1) + 12 * np.minimum(mark, 4) + 60 * np.minimum((end - start) // 4, 5)
    shape = shape * 2 + (_upper[b[start]] == 1)
    last = np.where(mark > 0, b[end - 1], 0)
    word[again] = AGAIN  # a token that repeats the one before stands for repetition
    return row, word, splitmix((shape * 256 + last).astype(np.uint64) + np.uint64(1 << 40))


def index_vectors(keys: np.ndarray, width: int) -> np.ndarray:
    """The random index vector of each key: 8 places, +1 or -1 each, drawn from the key alone."""
    out = np.zeros((len(keys), width))
    for k in range(8):
        x = splitmix(keys + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        np.add.at(out, (np.arange(len(keys)), (x >> np.uint64(8)).astype(np.int64) % width), np.where(x & np.uint64(1), 1.0, -1.0))
    return out / np.sqrt(8)


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of known tokens and shapes
    vectors: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    prior: float

    def places(self, word: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """The place of each token in ``keys``: its own, else its shape's, else -1."""
        out = np.full(len(word), -1)
        for key in (shape, word):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out = np.where(self.keys[at] == key, at, out)
        return out

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The mean token vector of each text, zero where it has no known token."""
        size = len(self.keys)
        out = []
        for i, j in runs_by_size([len(t) for t in texts], 1_000_000):
            for a in range(i, j, 1000):  # a matrix of at most 1000 texts by the vocabulary
                z = min(a + 1000, j)
                row, word, shape = tokens(texts[a:z])
                at = self.places(word, shape)
                counts = np.bincount(row[at >= 0] * size + at[at >= 0], minlength=(z - a) * size).reshape(z - a, size)
                out.append(counts @ self.vectors / np.maximum(1, counts.sum(axis=1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, self.vectors.shape[1]))

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2[0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.layers:
            return np.full(len(texts), self.prior)
        return sigmoid(self.logits(self.pooled(texts)) / self.temperature)


def word_vectors(texts: list[bytes], most: int = VOCABULARY, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Keys and word vectors of the most frequent tokens and shapes of the texts, by random indexing."""
    parts = [tokens(texts[i:j]) for i, j in runs_by_size([len(t) for t in texts], 2_000_000)]
    words, shapes = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64) for k in (1, 2))
    keep = []
    for key, share in ((shapes, most // 4), (words, most - most // 4)):
        own, count = np.unique(key, return_counts=True)
        keep.append(own[np.argsort(-count, kind="stable")][: min(share, int((count >= 3).sum()))])
    keys = np.unique(np.concatenate(keep))
    own = index_vectors(keys, width)
    if not len(keys):
        return keys, own
    model = Model(keys, own, [], 1, 0)
    context = np.zeros((len(keys), width))
    for row, word, shape in parts:
        at = model.places(word, shape)
        row, at = row[at >= 0], at[at >= 0]
        for step in range(1, WINDOW + 1):
            near = row[step:] == row[:-step]
            a, b = at[:-step][near], at[step:][near]
            for f in range(width):
                context[:, f] += np.bincount(a, own[b, f], len(keys)) + np.bincount(b, own[a, f], len(keys))
    return keys, own + context / np.maximum(1e-9, np.linalg.norm(context, axis=1, keepdims=True))


def fit(texts: list[bytes], y: np.ndarray, place: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """Fit vectors, network and temperature. ``place``: 0 to 1 for each row; the last fifth only fits the temperature.

    Without both labels in either part the score is the smoothed share of label 1.
    """
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    keys, vectors = word_vectors(texts)
    by = np.argsort(place, kind="stable")
    learn, tune = by[: len(by) * 4 // 5], by[len(by) * 4 // 5 :]
    if not len(keys) or not 0 < y[learn].sum() < len(learn) or not len(tune):
        return Model(keys, vectors, [], 1.0, prior)
    x = Model(keys, vectors, [], 1.0, prior).pooled(texts)
    rng = np.random.default_rng(seed)
    mean, scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-6
    w1, b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array([np.log(prior / (1 - prior))])
    adam = Adam([w1, b1, w2, b2], 0.005)
    z = (x - mean) / scale
    size = max(16, min(256, len(learn) // 8))
    for _ in range(epochs):
        order = rng.permutation(learn)
        for at in range(0, len(order), size):
            part = order[at : at + size]
            hidden = np.tanh(z[part] @ w1 + b1)
            slope = (sigmoid(hidden @ w2 + b2[0]) - y[part]) / len(part)
            back = slope[:, None] * w2 * (1 - hidden**2)
            adam.step([z[part].T @ back + 1e-3 * w1, back.sum(axis=0), hidden.T @ slope + 1e-3 * w2, np.array([slope.sum()])])
    model = Model(keys, vectors, [mean, scale, w1, b1, w2, b2], 1.0, prior)
    logits = model.logits(x[tune])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    loss = [-np.mean(y[tune] * np.log(p) + (1 - y[tune]) * np.log(1 - p)) for t in grid for p in [np.clip(sigmoid(logits / t), 1e-9, 1 - 1e-9)]]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    A null or empty text has the score of a text without tokens; texts of any length are scored whole. Repeated rows score alike; a null doc_id is never held
    out nor fitted on.
    """
    model = spark.sparkContext.broadcast(fit(*training_rows(spark, docs, labels, label, fit_rows)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = utf8_of(batch.column(1))
            score = model.value.score(body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
