"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits; two link when at most three differ. Its bits form
three segments of 23, 23 and 18 bits. The binary Golay code of length 23 is
perfect: each segment value lies within three bits of exactly one codeword. The
keys of a segment are the codewords within four bits of it, one or six of them.
Two values that differ in at most two bits share a key, because the codeword
nearest to a value between them is within four bits of both.

Of three errors spread over three segments, either some segment has none, and
then one of the pairs (exact segment, keys of the next one) agrees, since the
next one has at most two errors or the pairs after it agree; or each segment
has exactly one. In that case one side joins by its nearest codeword of the
first segment and all keys of the second, the other side the other way round.

Keys are shuffled, sorted in their tasks and read in runs; every candidate is
checked bit by bit. Runs longer than ``LONG_RUN`` are searched breadth first
and give a spanning forest instead of all pairs. Runs longer than ``SPLIT_RUN``
are sorted once for each quarter of the bits that vary in them: three errors
leave one quarter alone, so only what agrees in a quarter is compared. Copies fall together before,
as all of this works on distinct fingerprints.

Null texts count as empty; texts without a word have fingerprint zero and link
like any other. Rows without an id get a component but don't name one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.common import packed, unpacked, whole_text
from threadloom.llm.components import components
from threadloom.session import settle

SEED = 42
SHINGLE = 3
MAX_BITS = 3
HASHES_PER_BLOCK = 1 << 16
# The generator polynomial of the code; its degree leaves 12 message bits.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
LONG_RUN = 32
SPLIT_RUN = 1_000


def fingerprint(text: bytes) -> int:
    """The SimHash of a UTF-8 text over its three-word shingles, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends]
    hashes = (
        xxhash.xxh64_intdigest(joined[s : e - 1], SEED)
        for s, e in zip(starts, ends[min(SHINGLE, len(words)) - 1 :])
    )
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, HASHES_PER_BLOCK):
        block = np.fromiter(hashes, dtype="<u8", count=min(HASHES_PER_BLOCK, n - at))
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        found = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp`` (the bits as a signed long) of each row."""
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("text"))
    return texts.mapInArrow(fingerprint_tasks, "doc_id long, text_hash long, fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error bits and the keys' offsets from the nearest codeword's index; syndromes of 12 low bits
    and of 11 high bits."""

    def rest(value: int) -> int:
        for bit in range(22, 10, -1):
            if value >> bit & 1:
                value ^= GENERATOR << (bit - 11)
        return value

    syndromes = np.array([rest(1 << i) for i in range(23)])
    errors = np.zeros(2048, dtype=np.uint32)
    for weight in range(1, 4):
        for bits in combinations(range(23), weight):
            errors[np.bitwise_xor.reduce(syndromes[list(bits)])] = sum(1 << b for b in bits)
    codewords = np.array([m << 11 | rest(m << 11) for m in range(4096)], dtype=np.uint32)
    sevens = codewords[np.bitwise_count(codewords) == 7]
    offsets = np.zeros((2048, 6), dtype=np.int64)
    for s in np.flatnonzero(np.bitwise_count(errors) == 3):
        offsets[s, 1:] = sevens[sevens & errors[s] == errors[s]] >> 11
    of_value = np.zeros(1 << 12, dtype=np.uint16)
    of_high = np.zeros(1 << 11, dtype=np.uint16)
    for table, shift in ((of_value, 0), (of_high, 12)):
        for i in range(len(table).bit_length() - 1):
            table[1 << i : 2 << i] = table[: 1 << i] ^ syndromes[shift + i]
    return errors, offsets, np.concatenate([of_value, of_high])


def segment_keys(values: np.ndarray) -> np.ndarray:
    """Codeword indices of 23-bit values, six columns; the first is the nearest, the rest repeat it if there are no more."""
    errors, offsets, tables = golay()
    syndrome = tables[values & 4095] ^ tables[4096 + (values >> 12)]
    nearest = (values ^ errors[syndrome]).astype(np.int64) >> 11
    return nearest[:, None] ^ offsets[syndrome]


def blocking_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unsigned fingerprints and the row each belongs to, without repeats in a row."""
    parts = [(fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [segment_keys(p) for p in parts]
    columns = []
    for kind in range(3):
        exact, fuzzy = parts[kind], near[(kind + 1) % 3]
        columns.append((exact[:, None] << 12 | fuzzy) << 2 | kind)
    first, second = near[0], near[1]
    columns.append(((first[:, :1] << 12 | second) << 1) << 2 | 3)
    columns.append(((first << 12 | second[:, :1]) << 1) << 2 | 3)
    keys, rows = [], []
    for block in columns:
        fresh = np.ones(block.shape, dtype=bool)
        fresh[:, 1:] = block[:, 1:] != block[:, :1]
        row, column = np.nonzero(fresh)
        keys.append(block[row, column])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def key_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        keys, rows = blocking_keys(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["key", "fp"])


def forest(fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that join what is linked among distinct fingerprints, found breadth first."""
    left = fps
    while len(left):
        border, left = [left[0]], left[1:]
        while border and len(left):
            at = border.pop()
            close = np.bitwise_count(left ^ at) <= MAX_BITS
            border.extend(left[close])
            yield from ((int(at), int(x)) for x in left[close])
            left = left[~close]


def quarters(fps: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of a long run of distinct fingerprints, connected like those that link."""
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [1 << i for i in range(64) if varying >> i & 1]
    for part in range(MAX_BITS + 1):
        keys = fps & np.uint64(sum(bits[part :: MAX_BITS + 1]))
        order = np.argsort(keys, kind="stable")
        yield from linked(keys[order], fps[order], len(fps))


def linked(keys: np.ndarray, fps: np.ndarray, split: int = SPLIT_RUN) -> list[np.ndarray]:
    """Pairs of fingerprints that link, from whole runs of equal keys; connected alike, though not all of them."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    short = np.repeat(sizes <= LONG_RUN, sizes)
    k, f, found = keys[short], fps[short], []
    for step in range(1, min(LONG_RUN, int(sizes.max(initial=1)))):
        a, b = f[:-step], f[step:]
        close = (k[:-step] == k[step:]) & (a != b) & (np.bitwise_count(a ^ b) <= MAX_BITS)
        found.append(np.stack([a[close], b[close]]))
    for start, size in zip(starts[sizes > LONG_RUN], sizes[sizes > LONG_RUN]):
        run = np.unique(fps[start : start + size])
        if len(run) > split:
            found.extend(quarters(run))
            continue
        pairs = np.array(list(forest(run)), dtype=np.uint64)
        found.append(pairs.reshape(-1, 2).T)
    return found


def link_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by key; the last run of a batch waits for its continuation."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def edges(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = linked(k, f) if len(k) else []
        if found:
            a, b = np.unique(np.concatenate(found, axis=1), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        yield from edges(keys[:cut], fps[:cut])
        keys, fps = keys[cut:], fps[cut:]
    yield from edges(keys, fps)


def links(fps: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints, as signed longs."""
    keys = fps.select("fp").distinct().mapInArrow(key_tasks, "key long, fp long")
    ordered = keys.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(link_tasks, "a long, b long").distinct()


def roots(found: DataFrame) -> DataFrame:
    """``fp`` and ``root`` for every distinct fingerprint of ``fingerprints``' rows, as settled."""
    groups = components(links(found)).select(F.col("node").alias("fp"), "root")
    every = found.select("fp").distinct()
    return every.join(groups, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id``, one row per document."""
    found = settle(fingerprints(docs), "fingerprints")
    first = found.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    named = settle(first.join(roots(found), "fp"), "named")
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_fp = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return found.join(by_fp, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Of documents with that id the one with the smallest text hash stays, of
    equal rows one. Documents without an id stay.
    """
    found = settle(fingerprints(docs), "fingerprints")
    rooted = found.where("doc_id is not null").join(roots(found), "fp")
    lowest = rooted.groupBy("root", "doc_id").agg(F.min("text_hash").alias("text_hash"))
    first = lowest.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    chosen = first.select(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"))
    df = packed(docs)
    own = df.select("doc", F.col("doc.doc_id").cast("long").alias("id"), F.xxhash64(whole_text("doc.text")).alias("hash"))
    kept = own.join(chosen, ["id", "hash"]).dropDuplicates(["id", "hash"])
    return unpacked(kept, docs.columns).unionAll(unpacked(df.where("doc.doc_id is null"), docs.columns))
