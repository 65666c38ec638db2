"""Language identification with string kernels.

Two texts are as alike as the cosine of their sets of character n-grams of one
to four letters (a blended-spectrum presence kernel; n-grams are hashed). Each
text is described by its likeness to a few landmark texts, after Nyström: the
landmarks' own kernel matrix turns the likenesses into features. One ridge
regression per language, against the rest, is solved on them. Texts are scored
by batched matrix products: presence matrix by landmarks, then by weights.

Learns from a bounded sample: ``SAMPLE`` rows over all languages, evenly. A null
text, an empty one or one without a letter is ``und`` with score 0. If nothing
could be learned, all texts are. Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.common import held_out, whole_text
from threadloom.llm.ngrams import SPACE, codes, count_labels, letters, ngram_buckets, present, sampled_texts

UNKNOWN = "und"
ORDERS = range(1, 5)
BITS = 14
# Rows that are learned from, over all languages, and how many of them are landmarks.
SAMPLE = 1_600
LANDMARKS = 128
RIDGE = 1e-2
SHARPNESS = 4.0
TEXTS_PER_PRODUCT = 64


def spectrum(text: str) -> np.ndarray:
    """Distinct n-gram buckets of a text: letters in lower case, all else as single spaces."""
    points = codes(text.lower())
    points = np.where(letters(points), points, SPACE)
    kept = np.ones(len(points), dtype=bool)
    kept[1:] = (points[1:] != SPACE) | (points[:-1] != SPACE)
    return present(ngram_buckets(points[kept].astype(np.uint64), ORDERS, 0, BITS), 1 << BITS)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def matrix(rows: list[np.ndarray]) -> np.ndarray:
    """Presence rows of length one."""
    found = np.zeros((len(rows), 1 << BITS), dtype=np.float32)
    for row, buckets in zip(found, rows):
        row[buckets] = 1 / np.sqrt(max(1, len(buckets)))
    return found


class Model:
    """Languages, landmarks (as bucket lists) and the weights that map likenesses to scores."""

    def __init__(self, languages: list[str], landmarks: list[np.ndarray], weights: np.ndarray) -> None:
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    def predicted(self, texts: list[str | None], landmarks: np.ndarray) -> list[tuple[str, float]]:
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for at in range(0, len(known), TEXTS_PER_PRODUCT):
            some = known[at : at + TEXTS_PER_PRODUCT]
            scores = matrix([spectrum(texts[i]) for i in some]) @ landmarks @ self.weights
            chances = np.exp(SHARPNESS * (scores - scores.max(axis=1, keepdims=True)))
            chances /= chances.sum(axis=1, keepdims=True)
            for i, chance in zip(some, chances):
                best = int(chance.argmax())
                found[i] = (self.languages[best], float(min(1.0, chance[best])))
        return found


def solved(rows: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström features and one-versus-rest ridge regression, on the driver; all of its input is bounded."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], [], np.zeros((0, 0), np.float32))
    # Turn by turn one row of each language.
    turn = {language: [i for i, x in enumerate(labels) if x == language] for language in languages}
    order = [own[k] for k in range(max(map(len, turn.values()))) for own in turn.values() if k < len(own)]
    chosen = [rows[i] for i in order[:landmarks]]
    z = matrix(chosen).T
    values, vectors = np.linalg.eigh((z.T @ z).astype(np.float64))
    strong = values > 1e-6 * values.max()
    whiten = vectors[:, strong] / np.sqrt(values[strong])
    features = np.concatenate([matrix(rows[i : i + 256]) @ z for i in range(0, len(rows), 256)]) @ whiten
    target = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
    weight = 1 / np.array([len(turn[x]) for x in labels])
    weight *= len(labels) / weight.sum()
    left = (features * weight[:, None]).T @ features + ridge * len(labels) * np.eye(features.shape[1])
    return Model(languages, chosen, (whiten @ np.linalg.solve(left, features.T @ (target * weight[:, None]))).astype(np.float32))


def learned(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits a model to texts and languages of rows that aren't held out."""
    labelled = docs.select("doc_id", F.col("lang").alias("label"))
    per_label = max(1, sample // max(1, count_labels(labelled)))

    def tasks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            df = df[[has_letter(t) for t in df["text"]]]
            yield pd.DataFrame({"doc_id": df["doc_id"], "label": df["label"], "buckets": [spectrum(t) for t in df["text"]]})

    texts = sampled_texts(docs.select("doc_id", "text"), labelled, per_label)
    rows = texts.mapInPandas(tasks, "doc_id long, label string, buckets array<int>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label))
    return solved([np.array(r.buckets) for r in rows], [r.label for r in rows])


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of each document; reads nothing but id and text."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks = matrix(model.landmarks).T
        for batch in batches:
            found = []
            for at in range(0, len(batch), TEXTS_PER_PRODUCT):
                found += model.predicted(batch.column(2).slice(at, TEXTS_PER_PRODUCT).to_pylist(), landmarks)
            columns = [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    texts = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), whole_text().alias("text"))
    return texts.mapInArrow(tasks, "doc_id long, held_out boolean, lang_pred string, score double")
