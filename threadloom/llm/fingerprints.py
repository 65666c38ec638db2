"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes of a text; it depends on the last 32 bytes
only, so a boundary moves along with the text around it. Boundaries are
normalised: before the usual chunk length a stricter mask has to match, after
it a looser one, between a least and a greatest length. The fingerprint is the
set of 64-bit chunk digests, each weighted by its chunks' length; the likeness of
a fingerprint to another is its containment: the weight that the two share, as a
part of its own.

The empty text has the empty fingerprint; two empty fingerprints are alike
(1.0), an empty one is unlike any other (0.0). Null texts count as empty.
Equal texts have equal fingerprints. Documents are ordered by id, then by a
hash of the text, rows without an id last.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.common import whole_text

LEAST, USUAL, GREATEST = 8, 32, 128
# Bits of the gear hash that must be zero: one more than the usual length asks for, and one less.
STRICT = np.uint32(0b111111 << 26)
LOOSE = np.uint32(0b1111 << 28)
ROWS_PER_BUCKET = 1_000
MAX_BUCKETS = 20_000
BATCH = 256


@cache
def gear() -> np.ndarray:
    """A fixed pseudo-random 32-bit number for each byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear()[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8, 16):  # sums over 2, 4, ... 32 bytes
        h[shift:] += h[:-shift] << np.uint32(shift)
    loose = np.flatnonzero(h & LOOSE == 0) + 1
    strict = loose[h[loose - 1] & STRICT == 0].tolist()
    loose = loose.tolist()
    ends, at, s, k = [], 0, 0, 0
    while n - at > LEAST:
        s = bisect_left(strict, at + LEAST, s)
        if s < len(strict) and strict[s] < at + USUAL:
            at = strict[s]
        else:
            k = bisect_left(loose, at + USUAL, k)
            at = min(loose[k] if k < len(loose) else n, at + GREATEST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks(text: str) -> dict[int, int]:
    """Chunk digests and their weights: the bytes in chunks of that digest."""
    data = text.encode("utf-8", "surrogatepass")
    found: dict[int, int] = {}
    start = 0
    for end in cuts(data):
        digest = xxhash.xxh64_intdigest(data[start:end], 42)
        found[digest] = found.get(digest, 0) + end - start
        start = end
    return found


def written(found: dict[int, int]) -> str:
    return " ".join(f"{digest:016x}:{weight}" for digest, weight in sorted(found.items()))


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """How much of ``a`` is contained in ``b``."""
    if not a:
        return float(not b)
    shared = sum(min(a[d], b[d]) for d in a.keys() & b.keys())
    return shared / sum(a.values())


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each document."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([written(chunks(t.as_py())) for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "fingerprint"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(tasks, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of the text, replaced by as much of the following one or by all of that."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads documents of whole buckets in order; the first document of the next bucket (``tail``) ends each."""
    rows: list[tuple] = []
    held = None

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*rows))
        rows.clear()
        names = [x.split()[0] for x in COMPARED.split(", ")]
        kinds = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        for bucket, tail, doc_id, text in zip(*batch.columns):
            bucket, tail, text = bucket.as_py(), tail.as_py(), text.as_py()
            if tail and held is None:
                continue  # more rows with the id of that first document
            own = chunks(text)
            if held is not None and held[0] == bucket:
                _, before_id, before, before_chunks = held
                new = edited(before, text)
                new_chunks = chunks(new)
                rows.append((
                    before_id,
                    len(before),
                    hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                    written(before_chunks),
                    written(new_chunks),
                    likeness(before_chunks, new_chunks),
                    likeness(before_chunks, own),
                ))
                if len(rows) >= BATCH:
                    yield flushed()
            held = None if tail else (bucket, doc_id.as_py(), text, own)
    if rows:
        yield flushed()


def in_order(docs: DataFrame) -> DataFrame:
    """``bucket``, ``tail``, ``doc_id`` and ``text``, whole buckets in order of ids.

    Buckets are the ranges that Spark deals the ids to; their number is bounded
    and their least ids are all that the driver gets. The texts are shuffled
    once, the first document of each bucket also to the bucket before it, as
    its ``tail``.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    parts = max(1, min(MAX_BUCKETS, ids.count() // ROWS_PER_BUCKET))
    dealt = ids.where("doc_id is not null").repartitionByRange(parts, "doc_id")
    least = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("doc_id"))
    heads = np.array(sorted(r.doc_id for r in least.collect()), dtype=np.int64)
    buckets = max(1, len(heads))

    @F.pandas_udf("struct<bucket:int,head:boolean>")
    def place(found: pd.Series) -> pd.DataFrame:
        if not len(heads):  # no row has an id
            return pd.DataFrame({"bucket": np.zeros(len(found), np.int32), "head": np.ones(len(found), bool)})
        bucket = np.searchsorted(heads, found, side="right") - 1
        return pd.DataFrame({"bucket": bucket.astype(np.int32), "head": heads[bucket] == found.to_numpy()})

    at = lambda bucket, tail: F.struct(bucket.cast("int").alias("bucket"), F.lit(tail).alias("tail"))
    own = at(F.col("place.bucket"), False)
    before = at(F.pmod(F.col("place.bucket") - 1, F.lit(buckets)), True)
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    placed = placed.withColumn("place", place(F.coalesce("doc_id", F.lit(2**63 - 1))))
    rows = placed.select(
        "doc_id", "text", F.inline(F.when(F.col("place.head"), F.array(own, before)).otherwise(F.array(own)))
    )
    rows = rows.withColumn("text_hash", F.xxhash64("text")).repartition("bucket")
    order = ["bucket", "tail", F.col("doc_id").asc_nulls_last(), "text_hash"]
    return rows.sortWithinPartitions(*order).select("bucket", "tail", "doc_id", "text")


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness to it and to the next document's.

    The next document of the last one is the first; a single document is its own.
    """
    return in_order(docs).mapInArrow(compare_tasks, COMPARED)
