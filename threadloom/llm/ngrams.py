"""Hashed n-grams of whole texts, and bounded samples of labelled rows to learn from."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from threadloom.llm.common import held_out

SPACE = 32
# Shares of a label that are ranked by themselves.
SHARES = 64
PRIME = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@cache
def letter_table() -> np.ndarray:
    """Of the code points below 2**16: which are letters."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters; those beyond the table are taken for letters."""
    return letter_table()[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)


def hashed(values: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Buckets of 64-bit values by multiplicative hashing."""
    mixed = (values ^ np.uint64(salt * 0x2545F4914F6CDD1D % 2**64)) * PRIME
    mixed ^= mixed >> np.uint64(29)
    return (mixed * PRIME >> np.uint64(64 - bits)).astype(np.int64)


def ngram_buckets(values: np.ndarray, orders: range, salt: int, bits: int) -> list[np.ndarray]:
    """Buckets of the n-grams of a sequence of 64-bit values, by order."""
    found, gram = [], values
    for order in range(1, max(orders) + 1):
        if order > 1:
            gram = gram[:-1] * PRIME + values[order - 1 :]
        if not len(gram):
            break
        if order in orders:
            found.append(hashed(gram, salt + order, bits))
    return found


def present(buckets: list[np.ndarray], size: int) -> np.ndarray:
    """The distinct buckets, ordered."""
    flags = np.zeros(size, dtype=bool)
    for found in buckets:
        flags[found] = True
    return np.flatnonzero(flags)


def sampled_texts(docs: DataFrame, labelled: DataFrame, per_label: int) -> DataFrame:
    """``doc_id``, ``label``, ``text`` of at most ``per_label`` rows of each label that aren't held out.

    ``labelled`` has ``doc_id`` and ``label``, narrow columns only. Rows are
    taken in the order of a hash of their id; of rows with the same id the least
    counts. A label's rows are ranked in shares first, by another hash, and only
    the first of each share are ranked together. The chosen ids are few by that
    bound, so they are broadcast and no text is shuffled but the chosen ones.
    """
    one = labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = one.where(~held_out(F.col("doc_id"))).withColumn("share", F.pmod(F.hash("doc_id"), F.lit(SHARES)))
    for group in (["label", "share"], ["label"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= per_label)
    chosen = chosen.select(F.col("doc_id").alias("id"), "label")
    text = F.col("text").cast("string")
    joined = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "label", text.alias("text"))
    return joined.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def count_labels(labelled: DataFrame) -> int:
    return labelled.where("label is not null").select("label").distinct().count()
