"""A quality classifier: naive Bayes support vectors.

A text has indicators of its hashed n-grams: characters (two to four), words
(one and two) and word shapes (one to three; a shape is a word's case, last
sign, length and whether it repeats the word before). Each indicator is scaled
by the logarithm of the ratio of its smoothed frequencies in both classes. A
linear model is fitted to that under hinge loss by dual coordinate descent and
interpolated with the mean weight. A logistic curve over the margins of the
sample gives a score from 0 to 1.

Learns from a bounded sample of labelled rows, ``SAMPLE`` of each class. A null
text counts as empty, and an empty one is scored by the intercept alone. Without
rows of both classes every score is the share of good ones, 0.5 if there are
none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.common import held_out, whole_text
from threadloom.llm.ngrams import PRIME, SPACE, codes, letters, ngram_buckets, present, sampled_texts

BITS = 18
# Rows of each class that are learned from.
SAMPLE = 2_000
SMOOTHING = 1.0
COST = 0.01
EPOCHS = 12
INTERPOLATION = 0.5
PREDICTED_FROM = 0.3
LONGEST_POWER = 1 << 12


def powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64; long words start again."""
    with np.errstate(over="ignore"):
        first = np.cumprod(np.full(min(n, LONGEST_POWER), PRIME, dtype=np.uint64))
    return np.resize(first, n)


POWERS = powers(LONGEST_POWER)


def indicators(text: str) -> np.ndarray:
    """Distinct buckets of a text's n-grams."""
    points = codes(text)
    blank = (points == SPACE) | ((points >= 9) & (points <= 13))
    if blank.all():
        return np.empty(0, dtype=np.int64)
    chars = np.where(blank, SPACE, points).astype(np.uint64)
    found = ngram_buckets(chars, range(2, 5), 10, BITS)

    edges = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    inside = ~blank
    word = np.cumsum(np.r_[True, blank[:-1]] & inside) - 1
    place = np.arange(len(points)) - starts[np.maximum(word, 0)]
    shares = np.where(inside, chars * POWERS[place % LONGEST_POWER], 0).astype(np.uint64)
    words = np.add.reduceat(shares, starts)
    found += ngram_buckets(words, range(1, 3), 20, BITS)

    alphabetic = letters(points)
    upper = np.add.reduceat((alphabetic & inside & (points >= 65) & (points <= 90)).astype(np.int64), starts)
    alpha = np.add.reduceat((alphabetic & inside).astype(np.int64), starts)
    size = ends - starts
    last = points[ends - 1]
    sign = np.where(letters(last), 0, np.where(np.isin(last, [44, 46]), 1, 2 + last % 61))
    case = np.where(alpha == 0, 3, np.where((upper == alpha) & (alpha > 1), 2, np.where(upper > 0, 1, 0)))
    again = np.r_[False, words[1:] == words[:-1]]
    shapes = case + 4 * again + 8 * np.minimum(size, 15) + 128 * sign
    found += ngram_buckets(shapes.astype(np.uint64), range(1, 4), 30, BITS)
    return present(found, 1 << BITS)


class Model:
    """Weights by bucket, the intercept, and slope and shift of the logistic curve."""

    def __init__(self, weights: np.ndarray, intercept: float, slope: float, shift: float) -> None:
        self.weights, self.intercept, self.slope, self.shift = weights, intercept, slope, shift

    def score(self, buckets: np.ndarray) -> float:
        margin = float(self.weights[buckets].sum()) / np.sqrt(max(1, len(buckets))) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray, smoothing: float) -> np.ndarray:
    counts = np.full((2, 1 << BITS), smoothing)
    for buckets, y in zip(rows, good):
        counts[int(y), buckets] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_descent(rows, scaled, y, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of least hinge loss; one dual variable at a time, in a fixed random order."""
    weights, intercept = np.zeros(1 << BITS), 0.0
    dual = np.zeros(len(rows))
    norms = np.array([x @ x + 1 for x in scaled])
    # Both classes weigh alike.
    limit = cost * len(y) / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            gradient = y[i] * (weights[rows[i]] @ scaled[i] + intercept) - 1
            new = min(max(dual[i] - gradient / norms[i], 0.0), limit[i])
            step = (new - dual[i]) * y[i]
            if step:
                dual[i] = new
                weights[rows[i]] += step * scaled[i]
                intercept += step
    return weights, intercept


def logistic(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with targets drawn in a little from 0 and 1."""
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    at = np.array([1.0, 0.0])
    weight = len(good) / 2 / np.where(good, good.sum(), (~good).sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (weight * (target - p)) - 1e-6 * at)
        at += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def fitted(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """On the driver: the sample is bounded, and so are a row's buckets."""
    if good.all() or not good.any():
        share = float(good.mean()) if len(good) else 0.5
        shift = np.log((share + 1e-9) / (1 - share + 1e-9))
        return Model(np.zeros(1 << BITS), 0.0, 0.0, float(shift))
    ratios = log_count_ratios(rows, good, SMOOTHING)
    scaled = [ratios[b] / np.sqrt(max(1, len(b))) for b in rows]
    weights, intercept = dual_descent(rows, scaled, np.where(good, 1.0, -1.0), COST, EPOCHS)
    seen = np.abs(weights[weights != 0]).mean() if (weights != 0).any() else 0.0
    weights = ((1 - INTERPOLATION) * seen + INTERPOLATION * weights) * ratios
    margins = np.array([weights[b].sum() / np.sqrt(max(1, len(b))) for b in rows]) + intercept
    return Model(weights.astype(np.float32), intercept, *logistic(margins, good))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits a model to the ``quality`` of rows that aren't held out."""
    labelled = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1)")

    def tasks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            buckets = [indicators(t or "") for t in df["text"]]
            yield pd.DataFrame({"doc_id": df["doc_id"], "label": df["label"], "buckets": buckets})

    texts = sampled_texts(docs.select("doc_id", "text"), labelled, sample)
    rows = texts.mapInPandas(tasks, "doc_id long, label int, buckets array<int>").toArrow()
    rows = rows.take(pa.compute.sort_indices(rows, sort_keys=[("doc_id", "ascending")]))
    buckets = [x.values.to_numpy(zero_copy_only=False) for x in rows["buckets"]]
    return fitted(buckets, rows["label"].to_numpy() == 1)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each document; reads nothing but id and text."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([model.score(indicators(t.as_py())) for t in batch.column(2)], dtype=np.float64)
            predicted = pa.array((score >= PREDICTED_FROM).astype(np.int32))
            columns = [batch.column(0), batch.column(1), pa.array(score), predicted]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), whole_text().alias("text"))
    return texts.mapInArrow(tasks, "doc_id long, held_out boolean, score double, predicted int")
