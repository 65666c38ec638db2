"""Removal of lines that are near-copies of a line elsewhere, by MinHash.

Lines are compared with A-Z in lower case and without blanks around them, as sets
of eight-character shingles (a shorter line is one shingle). Equal lines fall
together by a 64-bit hash. Signatures of forty minima form ten bands of four; at
a similarity of 0.8 two lines miss each other in all bands in one of two hundred
cases, at 0.9 in one of forty thousand. Lines that share a band are verified by
their exact Jaccard similarity, linked from 0.8 on, and each connected component
keeps the occurrence in the smallest document id and line number.

A band's lines are searched breadth first, so that close groups of any size take
little more than one comparison a line and give a spanning forest, not all pairs.
A task holds a block of them at a time; those of a bigger band wait in a temporary
file and are read past one block after the other, until all that were in no block
are known to be connected. Very big bands are dealt to several tasks, each of which
has two parts of the lines, so that any two lines meet.
Only lines that share a band with another one are fetched as text.

Lines without a visible character always stay. Null texts stay null, empty ones
empty. Rows that agree in id and text are one document and are treated alike;
rows without an id come last in order.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from tempfile import TemporaryFile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.common import packed, unpacked, whole_text
from threadloom.llm.components import components
from threadloom.session import settle, small_side

SHINGLE = 8
BANDS, ROWS = 10, 4
SIMILARITY = 0.8
# Texts whose lines are hashed together: small enough for the processor's cache.
CHARS_PER_BLOCK = 150_000
REMEMBERED_LINES = 500_000
# Lines of a band that a task compares at a time, and their characters.
LINES_PER_BLOCK, BLOCK_CHARS = 2_000, 400_000
# Lines of a band that one task takes, and parts that a bigger one is dealt to at most.
LINES_PER_TASK, MOST_PARTS = 50_000, 16
PRIME = np.uint64(0x9E3779B97F4A7C15)

LINES = "doc_id long, text_hash long, line_no int, line_hash long, bands array<long>"


def constants() -> tuple[np.ndarray, np.ndarray]:
    """Fixed pseudo-random masks and odd factors, one for each minimum."""
    random = np.random.default_rng(7)
    return random.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32), random.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * 2 + 1


MASKS, FACTORS = constants()


def normal(line: bytes) -> bytes:
    return line.strip().lower()


def rolled_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles that begin at each character of the lines, where each line begins, and its shingles' number.

    The last characters of a line begin none. A line shorter than a shingle has one, all of it.
    """
    lengths = np.array([len(x) for x in lines])
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    rolled = points.copy()
    for step in range(1, SHINGLE):
        rolled[:-step] = rolled[:-step] * PRIME + points[step:]
    rolled ^= rolled >> np.uint64(31)
    rolled *= PRIME
    starts = np.cumsum(lengths) - lengths
    for i in np.flatnonzero(lengths < SHINGLE):
        rolled[starts[i]] = xxhash.xxh64_intdigest(lines[i].encode("utf-8", "surrogatepass"))
    return rolled, starts, np.maximum(lengths - SHINGLE + 1, 1)


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all shingles of the lines, and where each line's begin."""
    rolled, starts, counts = rolled_hashes(lines)
    first = np.cumsum(counts) - counts
    place = np.arange(counts.sum()) - np.repeat(first, counts) + np.repeat(starts, counts)
    return (rolled >> np.uint64(32)).astype(np.uint32)[place], first


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """For each line its distinct shingles, as ordered 64-bit hashes."""
    rolled, starts, counts = rolled_hashes(lines)
    found = []
    for start, count in zip(starts.tolist(), counts.tolist()):
        own = np.sort(rolled[start : start + count])
        found.append(own[np.append(True, own[1:] != own[:-1])])
    return found


def band_keys(lines: list[str]) -> np.ndarray:
    """Ten keys for each non-empty line."""
    hashes, first = shingle_hashes(lines)
    lows = np.empty((len(lines), BANDS * ROWS), dtype=np.uint64)
    for k, (mask, factor) in enumerate(zip(MASKS, FACTORS)):
        lows[:, k] = np.minimum.reduceat((hashes ^ mask) * factor, first)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(lines), 1))
    for row in range(ROWS):
        keys = (keys ^ lows[:, row::ROWS]) * PRIME
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def line_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each line with a visible character. Bands stand at the first of equal lines that a task sees."""
    seen: set[int] = set()
    rows: list[tuple[int, int, int, int]] = []
    new: list[str] = []
    at: list[int] = []

    def flushed() -> pa.RecordBatch:
        bands: list = [None] * len(rows)
        if new:
            for place, keys in zip(at, band_keys(new)):
                bands[place] = keys
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
        columns.append(pa.array(bands, pa.list_(pa.int64())))
        rows.clear(), new.clear(), at.clear()
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in LINES.split(", ")])

    chars = 0
    for batch in batches:
        for doc_id, text_hash, text in zip(*batch.columns):
            doc_id, text_hash, text = doc_id.as_py(), text_hash.as_py(), text.as_py()
            for number, raw in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                line = normal(raw)
                if not line:
                    continue
                line_hash = xxhash.xxh64_intdigest(line) - 2**63
                if line_hash not in seen:
                    if len(seen) >= REMEMBERED_LINES:
                        seen.clear()
                    seen.add(line_hash)
                    at.append(len(rows))
                    new.append(line.decode("utf-8", "surrogatepass"))
                    chars += len(line)
                rows.append((doc_id, text_hash, number, line_hash))
                if chars >= CHARS_PER_BLOCK or len(rows) >= 10_000:
                    yield flushed()
                    chars = 0
    if rows:
        yield flushed()


def lines_of(docs: DataFrame) -> DataFrame:
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(line_tasks, LINES)


def group_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by band key: the members of each band that holds different lines, named by a hash of them."""
    keys, lines = np.empty(0, np.int64), np.empty(0, np.int64)

    def groups(k: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(k):
            return
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        ends = np.r_[starts[1:], len(k)]
        mixed = np.flatnonzero(np.minimum.reduceat(h, starts) != np.maximum.reduceat(h, starts))
        names, members = [], []
        known = set()
        for i in mixed:
            own = np.unique(h[starts[i] : ends[i]])
            name = xxhash.xxh64_intdigest(own.tobytes()) - 2**63
            if name not in known:
                known.add(name)
                names.append(np.full(len(own), name))
                members.append(own)
        if names:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(names)), pa.array(np.concatenate(members))], ["name", "line_hash"]
            )

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        lines = np.concatenate([lines, batch.column(1).to_numpy(zero_copy_only=False)])
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        yield from groups(keys[:cut], lines[:cut])
        keys, lines = keys[cut:], lines[cut:]
    yield from groups(keys, lines)


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def alike(a: set[str], b: set[str]) -> bool:
    low, high = sorted((len(a), len(b)))
    if low < SIMILARITY * high:
        return False
    shared = len(a & b)
    return shared >= SIMILARITY * (low + high - shared)


def similar(own: np.ndarray, others: list[np.ndarray]) -> list[bool]:
    """Which of the others' shingles are similar to a line's."""
    sizes = np.array([len(x) for x in others])
    every = np.concatenate(others)
    at = np.searchsorted(own, every)
    at[at == len(own)] = 0
    shared = np.add.reduceat(own[at] == every, np.cumsum(sizes) - sizes, dtype=np.int64)
    return (shared >= SIMILARITY * (sizes + len(own) - shared)).tolist()


def verified(hashes: list[int], grams: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the similar lines among the members of a band."""
    left = list(zip(hashes, grams))
    while left:
        border = [left.pop()]
        while border and left:
            at, own = border.pop()
            # Of lines so unequal in length no comparison is needed.
            near = [i for i, (_, x) in enumerate(left) if min(len(x), len(own)) >= SIMILARITY * max(len(x), len(own))]
            hits = {i for i, hit in zip(near, similar(own, [left[i][1] for i in near])) if hit} if near else set()
            for i in hits:
                border.append(left[i])
                yield at, left[i][0]
            left = [x for i, x in enumerate(left) if i not in hits]


class Block:
    """Some members of a band, by place, and the shingles they have."""

    def __init__(self, places: list[int], lines: list[str]) -> None:
        self.places, own = places, [shingles(x) for x in lines]
        self.sizes, self.first = np.array([len(x) for x in own]), own[0]
        having: dict[str, list[int]] = {}
        for at, grams in enumerate(own):
            for gram in grams:
                having.setdefault(gram, []).append(at)
        self.having = {gram: np.array(x, np.int32) for gram, x in having.items()}

    def similar(self, own: set[str]) -> list[int]:
        """Places of the members that are similar to a line of these shingles."""
        having = [x for x in map(self.having.get, own) if x is not None]
        if not having:
            return []
        shared = np.bincount(np.concatenate(having), minlength=len(self.sizes))
        return [self.places[i] for i in np.flatnonzero(shared >= SIMILARITY * (self.sizes + len(own) - shared))]


class Band:
    """The members of a band: a first block of lines, the others in a file."""

    def __init__(self) -> None:
        self.hashes, self.lines, self.chars, self.file = array("q"), [], 0, None

    def fits(self, lines: list[str], chars: int) -> bool:
        return not lines or len(lines) < LINES_PER_BLOCK and chars <= BLOCK_CHARS

    def add(self, line_hash: int, line: str) -> None:
        self.hashes.append(line_hash)
        if self.file is None and self.fits(self.lines, self.chars + len(line)):
            self.lines.append(line)
            self.chars += len(line)
            return
        if self.file is None:
            self.file = TemporaryFile()
        self.file.write(line.encode("utf-8", "surrogatepass") + b"\n")

    def filed(self, wanted: np.ndarray) -> Iterator[tuple[int, str]]:
        """Place and line of the wanted members in the file."""
        self.file.seek(0)
        for at, raw in enumerate(self.file, len(self.lines)):
            if wanted[at]:
                yield at, raw[:-1].decode("utf-8", "surrogatepass")

    def edges(self) -> Iterator[tuple[int, int]]:
        """A spanning forest of the similar lines of a band with a file."""
        with self.file:
            for a, b in self.joined():
                yield self.hashes[a], self.hashes[b]

    def joined(self) -> Iterator[tuple[int, int]]:
        root = array("q", range(len(self.hashes)))

        def find(at: int) -> int:
            while root[at] != at:
                root[at] = at = root[root[at]]
            return at

        # Members of past blocks are compared with all others.
        waiting = np.ones(len(root), bool)
        places, lines = list(range(len(self.lines))), self.lines
        while True:
            block = Block(places, lines)
            waiting[places] = False
            for at, line in zip(places, lines):
                for other in block.similar(shingles(line)):
                    if find(at) != find(other):
                        yield other, at
                        root[find(at)] = find(other)
            groups = {find(x) for x in places}
            for at, line in self.filed(waiting):
                own = find(at)
                if groups == {own}:
                    continue
                grams = shingles(line)
                near = places[:1] if len(groups) == 1 and alike(block.first, grams) else block.similar(grams)
                reached = {find(x): x for x in near}
                reached.pop(own, None)
                for other, x in reached.items():
                    yield x, at
                    root[find(at)] = other
                if len(reached) > 1 or reached and own in groups:
                    groups = {find(x) for x in places}
            # Of those that wait only what is outside the largest group needs to meet the others.
            left = np.flatnonzero(waiting)
            roots = np.fromiter(map(find, left.tolist()), np.int64, len(left))
            names, counts = np.unique(roots, return_counts=True)
            if len(names) < 2:
                return
            strays = np.zeros(len(root), bool)
            strays[left[roots != names[counts.argmax()]]] = True
            places, lines, chars = [], [], 0
            for at, line in self.filed(strays):
                chars += len(line)
                if not self.fits(lines, chars):
                    break
                places.append(at)
                lines.append(line)


def small_edges(bands: list[Band]) -> Iterator[tuple[int, int]]:
    """The forests of bands that have no file; their shingles are hashed together."""
    grams = iter(shingle_sets([x for band in bands for x in band.lines]) if bands else [])
    for band in bands:
        yield from verified(band.hashes, [next(grams) for _ in band.lines])


def band_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
    name, band, waiting, chars = None, Band(), [], 0
    for batch in batches:
        for own, line_hash, line in zip(*(c.to_pylist() for c in batch.columns)):
            if own != name:
                if band.file is not None:
                    yield from band.edges()
                else:
                    waiting.append(band)
                    chars += band.chars
                name, band = own, Band()
                if chars >= CHARS_PER_BLOCK:
                    yield from small_edges(waiting)
                    waiting, chars = [], 0
            band.add(line_hash, line)
    yield from small_edges(waiting)
    yield from band.edges() if band.file is not None else small_edges([band])


def verify_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by band: edges between similar lines."""
    found: list[tuple[int, int]] = []

    def flushed() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*found)]
        found.clear()
        return pa.RecordBatch.from_arrays(columns, ["a", "b"])

    for edge in band_edges(batches):
        found.append(edge)
        if len(found) >= 10_000:
            yield flushed()
    if found:
        yield flushed()


def dealt(groups: DataFrame) -> DataFrame:
    """Groups of more than ``LINES_PER_TASK`` lines as several, one for each two parts of the lines."""
    sizes = groups.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > LINES_PER_TASK)
    parts = F.least(F.ceil(F.col("n") * 2 / LINES_PER_TASK), F.lit(MOST_PARTS)).cast("int")
    big = small_side(sizes.select("name", parts.alias("parts")))
    own = F.pmod(F.xxhash64("line_hash"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != F.col("own"))
    names = F.transform(others, lambda i: F.xxhash64("name", F.least(i, "own"), F.greatest(i, "own")))
    several = groups.join(big, "name").withColumn("own", own).select(F.explode(names).alias("name"), "line_hash")
    return groups.join(big, "name", "left_anti").unionByName(several)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc`` (all columns), ``text`` and the two columns that name a document."""
    df = packed(docs).withColumn("text", whole_text("doc.text"))
    return df.select("doc", "text", F.col("doc.doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))


def same_document(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def fetched(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``line_hash`` and normal ``line`` at the places (``doc_id``, ``text_hash``, ``line_no``), wherever they are few or many.

    Documents are shuffled by name, whatever the number of places.
    """
    wanted = places.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("line_no", "line_hash")).alias("wanted"))
    wanted = wanted.hint("shuffle_hash")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("text")
    )
    joined = texts.join(wanted, same_document(texts, wanted)).select(F.split("text", "\n").alias("lines"), "wanted")
    rows = joined.select(
        F.inline(F.transform("wanted", lambda w: F.struct(w["line_hash"].alias("line_hash"), F.get(F.col("lines"), w["line_no"]).alias("line"))))
    )
    ascii_lower = F.translate(F.trim("line", F.lit(" \t\n\x0b\x0c\r")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rows.select("line_hash", ascii_lower.alias("line")).dropDuplicates(["line_hash"])


def decisions(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_lines`` and ``removed`` (line numbers) of every document with a visible line."""
    lines = settle(lines_of(docs), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash", "line_no").alias("place")
    first = settle(lines.groupBy("line_hash").agg(F.min(place).alias("place")), "first")

    bands = lines.where("bands is not null").select(F.explode("bands").alias("key"), "line_hash")
    groups = bands.repartition("key").sortWithinPartitions("key").mapInArrow(group_tasks, "name long, line_hash long")
    groups = settle(groups.distinct(), "groups")
    places = groups.select("line_hash").distinct().join(first, "line_hash").select("line_hash", "place.*")
    texts = settle(fetched(docs, places), "line-texts")
    members = dealt(groups).join(texts, "line_hash").select("name", "line_hash", "line")
    edges = members.repartition("name").sortWithinPartitions("name").mapInArrow(verify_tasks, "a long, b long")
    found = components(edges)

    rooted = first.join(found, first["line_hash"] == found["node"], "left").select(
        "line_hash", "place", F.coalesce("root", "line_hash").alias("root")
    )
    kept = rooted.groupBy("root").agg(F.min("place").alias("kept"))
    by_line = rooted.join(kept, "root").select("line_hash", F.col("kept").alias("kept"))
    marked = lines.select("line_hash", place, "doc_id", "text_hash", "line_no").join(by_line, "line_hash")
    rows = marked.groupBy("doc_id", "text_hash", "line_no").agg(F.max(F.col("place") != F.col("kept")).alias("gone"))
    return rows.groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n_lines"),
        F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("line_no")))).alias("removed"),
    )


def removed_lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines`` (with a visible character), ``n_removed`` and ``removed`` (their numbers) of every row."""
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash"))
    found = decisions(docs)
    joined = every.join(found, same_document(every, found), "left")
    none = F.array().cast("array<int>")
    return joined.select(
        every["doc_id"],
        F.coalesce(found["n_lines"], F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(F.coalesce("removed", none).cast("array<string>"), ",").alias("removed"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents without those lines; ``n_chars`` follows the text."""
    every = keyed(docs)
    found = decisions(docs).where(F.size("removed") > 0).withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    found = found.hint("shuffle_hash")
    joined = every.join(found, every["doc_id"].eqNullSafe(found["id"]) & (every["text_hash"] == found["hash"]), "left")
    split = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), F.col("removed"))
    shorter = F.array_join(F.transform(left, lambda i: F.get(F.col("split"), i)), "\n")
    text = F.when(F.col("removed").isNotNull(), shorter).otherwise(F.col("doc.text"))
    df = joined.withColumn("split", split).withColumn("kept_text", text)
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("removed").isNotNull(), F.length("kept_text")).otherwise(F.col("doc.n_chars"))
        changed["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType)
    return unpacked(df, docs.columns, **changed)
