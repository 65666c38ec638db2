"""Periodic runs of words, found with string synchronising sets.

A run is a stretch of words of smallest period ``q`` and at least ``max(6, 4 q)``
words that no neighbouring word extends. Periods up to ``DIRECT`` are read off
by comparing each word with the one ``q`` before it. For the others there is one
scale ``t`` (a power of two) with ``t <= q < 2 t``. At this scale every stretch
of ``t`` words has a hash, and a place is *selected* if the least hash among the
``t + 1`` stretches that begin there or up to ``t`` later is that of the first or
the last of them. Whether a place is selected depends on the ``2 t`` words from it
on only, so equal contexts are selected alike, and every ``t`` places in a row
hold a selected one. Neighbouring selected places of equal context that lie
``q`` apart propose ``q`` as a period, which comparing words extends to the
longest stretch.

Stretches of ``t`` words with a period of ``t / 4`` or less would make every place
a selected one. They are left out: each lies in a run of such a period, which a
smaller scale has found, so the runs found so far supply the regions. In a run of
period ``t <= q < 2 t`` none of its first ``t`` windows lies wholly in such a region
(its period would divide ``q``), so the first ``t`` places have a selected one, and
with ``4 q`` words the place ``q`` further on has its whole context in the run.
What is proposed is compared word by word; equal 64-bit hashes of unlike stretches
could at most hide one of a run's several proposals.

Texts are taken a block at a time, one after the other with a separating word
of its own between them, so short texts cost no more per word than long ones. A
text is never cut: one that is longer than a block is a block by itself. Time is
in proportion to ``n log^2 n`` words, memory to the block. Rows stay in the task
that read them: there is no shuffle, copies and hot sources change nothing.

Null and empty texts have no words and no run; a null id changes no word. Rows
with repeated ids are separate documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.common import whole_text

LEAST_WORDS = 6
LEAST_REPEATS = 4
# Periods found by direct comparison; the first scale is one more.
DIRECT = 3
WORDS_PER_BLOCK = 250_000

MIX = np.uint64(0x9E3779B97F4A7C15)
TURN = np.uint64(0xD1B54A32D192ED03)
NEVER = np.uint64(2**64 - 1)

Runs = list[tuple[int, int, int]]


def scrambled(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * MIX
    return values ^ (values >> np.uint64(29))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs of neighbouring stretches."""
    return scrambled(scrambled(left) * TURN + right)


def stretches(matches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true values start and end."""
    turns = np.flatnonzero(np.diff(np.concatenate([[False], matches, [False]])))
    return turns[::2], turns[1::2]


def direct_runs(words: np.ndarray, period: int) -> Runs:
    """Stretches of at least four times the period, by comparing each word with the one a period on."""
    starts, ends = stretches(words[:-period] == words[period:])
    long = ends - starts >= (LEAST_REPEATS - 1) * period
    return [(s, e + period, period) for s, e in zip(starts[long].tolist(), ends[long].tolist())]


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    least, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    return least


def selected(hashes: np.ndarray, scale: int, found: Runs) -> np.ndarray:
    """The synchronising places at a scale; ``found`` has all runs of a quarter of it or less."""
    marks = np.zeros(len(hashes) + 1, np.int64)
    for start, end, period in found:
        if LEAST_REPEATS * period <= scale <= end - start:
            marks[start] += 1
            marks[end - scale + 1] -= 1
    hashes = np.where(np.cumsum(marks[:-1]) > 0, NEVER, hashes)
    least = window_least(hashes, scale + 1)
    ends = (least == hashes[: len(least)]) | (least == hashes[scale:])
    return np.flatnonzero(ends & (least != NEVER))


def proposals(contexts: np.ndarray, places: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of neighbours of equal context, ordered by period and place."""
    order = np.argsort(contexts, kind="stable")
    same = contexts[order[1:]] == contexts[order[:-1]]
    place = places[order[:-1]][same]
    period = places[order[1:]][same] - place
    fits = (period >= scale) & (period < 2 * scale)
    place, period = place[fits], period[fits]
    order = np.lexsort((place, period))
    return place[order], period[order]


def agreeing(words: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words from ``at`` on (or before it, if ``step`` is -1) equal the one a period later."""
    agreed, size = 0, 64
    while True:
        if step > 0:
            own = words[at + agreed : at + agreed + size]
            other = words[at + agreed + period : at + agreed + period + size]
            own = own[: len(other)]
        else:
            lo = max(at - agreed - size, 0)
            own = words[lo : at - agreed][::-1]
            other = words[lo + period : at - agreed + period][::-1]
        unlike = own != other
        if not len(own):
            return agreed
        first = int(unlike.argmax())
        if unlike[first]:
            return agreed + first
        agreed += len(own)
        size *= 2


def extended(words: np.ndarray, places: np.ndarray, periods: np.ndarray) -> Runs:
    """The longest stretches of the proposed periods around the proposed places, if they are long enough."""
    found, last, reach = [], 0, -1
    for at, period in zip(places.tolist(), periods.tolist()):
        if period == last and at < reach:
            continue
        ahead = agreeing(words, at, period, 1)
        start, end = at - agreeing(words, at, period, -1), at + ahead + period
        # Until here every word equals the one a period later, so a place before it proposes the same stretch.
        last, reach = period, at + ahead
        if end - start >= LEAST_REPEATS * period:
            found.append((start, end, period))
    return found


def smallest(found: Runs) -> Runs:
    """Of the same stretch the smallest period: any other is a multiple of it."""
    least: dict[tuple[int, int], int] = {}
    for start, end, period in found:
        least[start, end] = min(period, least.get((start, end), period))
    return [(start, end, period) for (start, end), period in least.items()]


def runs(words: np.ndarray, longest: int | None = None) -> Runs:
    """``(start, end, period)`` of every run, ordered by start, then period; no text has over ``longest`` words."""
    longest = len(words) if longest is None else longest
    found: Runs = []
    for period in range(1, DIRECT + 1):
        if LEAST_REPEATS * period <= longest:
            found = smallest(found + direct_runs(words, period))
    scale, hashes = 1, scrambled(words.astype(np.uint64) + MIX)
    while LEAST_REPEATS * scale <= longest:
        if scale > DIRECT:
            places = selected(hashes, scale, found)
            contexts = joined(hashes[places], hashes[places + scale])
            found = smallest(found + extended(words, *proposals(contexts, places, scale)))
        hashes = joined(hashes[: len(hashes) - scale], hashes[scale:])
        scale *= 2
    return sorted([r for r in found if r[1] - r[0] >= LEAST_WORDS], key=lambda r: (r[0], r[2]))


def stuttered(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document; a tenth of all ids repeat a stretch of theirs to the end."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    own = words[a : a + p]
    return words[:a] + (own * ((n - a) // p + 1))[: n - a]


def report(words: list[bytes], found: Runs) -> tuple:
    """Number of runs, the run of greatest length to period, and the digests of all runs and of the words kept."""
    best = None
    for start, end, period in found:
        length = end - start
        # Exact: length / period > best length / best period.
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    lines = "".join([f"{s},{e - s},{p}\n" for s, e, p in found])
    if found:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, end, period in found:
            gone[start + period] += 1
            gone[end] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    return (
        len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(),
    )


def block_runs(texts: list[list[bytes]]) -> list[Runs]:
    """The runs of each text, from all of them in one sequence."""
    number: dict[bytes, int] = {}
    codes, starts, at = [], [], 0
    for n, words in enumerate(texts):
        starts.append(at)
        codes.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        # No word, and unlike any other separator.
        codes.append(np.array([-1 - n]))
        at += len(words) + 1
    found: list[Runs] = [[] for _ in texts]
    every = runs(np.concatenate(codes), max(map(len, texts)))
    owners = np.searchsorted(starts, [s for s, _, _ in every], side="right") - 1
    for (s, e, p), n in zip(every, owners.tolist()):
        found[n].append((s - starts[n], e - starts[n], p))
    return found


def blocks(rows: Iterator[tuple[int | None, list[bytes]]], most: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    held, size = [], 0
    for row in rows:
        if held and size + len(row[1]) > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[1])
    if held:
        yield held


COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
LISTED = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def words_of(batches: Iterator[pa.RecordBatch], planted: bool) -> Iterator[tuple[int | None, list[bytes]]]:
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            # Bytes are split at spaces, tabs and line ends, and at nothing else.
            words = text.as_buffer().to_pybytes().split()
            yield doc_id, stuttered(words, doc_id) if planted else words


def periodic_runs(docs: DataFrame, words_per_block: int = WORDS_PER_BLOCK) -> DataFrame:
    """``doc_id``, all runs of each text, and the text without the repeats of its runs, by single spaces."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])
        for block in blocks(words_of(batches, planted=False), words_per_block):
            rows = []
            for (doc_id, words), found in zip(block, block_runs([w for _, w in block])):
                gone = {i for s, e, p in found for i in range(s + p, e)}
                kept = b" ".join([w for i, w in enumerate(words) if i not in gone]).decode("utf-8", "replace")
                rows.append({"doc_id": doc_id, "runs": [{"start": s, "length": e - s, "period": p} for s, e, p in found], "collapsed": kept})
            yield pa.RecordBatch.from_pylist(rows, schema)

    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return texts.mapInArrow(tasks, LISTED)


def run_digests(docs: DataFrame, words_per_block: int = WORDS_PER_BLOCK) -> DataFrame:
    """One row per document: how many runs, the strongest one, and digests of all runs and of the words kept.

    Documents whose id's checksum is divisible by ten are read with a repeated
    stretch of their own (``stuttered``).
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in COLUMNS.split(", ")]
        for block in blocks(words_of(batches, planted=True), words_per_block):
            found = block_runs([w for _, w in block])
            rows = [(doc_id, *report(words, own)) for (doc_id, words), own in zip(block, found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return texts.mapInArrow(tasks, COLUMNS)
