"""Best-fit packing of token sequences, with residual bins merged up a tree.

Each task packs the pieces it holds best-fit, longest first, and emits the bins
that are full but for a few tokens. A bin that is not becomes an item as long as
its content. The items of several tasks meet in one task of the next level,
which packs them best-fit again, and so on up to a single task, which emits all
of its bins.

Of the bins that a task leaves open at most one is no more than half full, as any
two of those fit into one. Two that are more than half full never meet. So what the
next level can save is bounded by the number of bins that are no more than half
full, and as many of the others, those with the most room, are all that it needs:
the rest is emitted as it is. The upper levels get two bins for each task below
them, whatever the lengths.

Only lengths and ids travel. A document's tokens are those of a byte-level
vocabulary followed by one separator, so that empty and null texts are one token
long. A document longer than a sequence is cut into full pieces; its first piece
takes the remainder. Repeated rows are packed one by one.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.common import whole_text
from threadloom.llm.words import Bounded, byte_letters, public_path, public_pattern
from threadloom.session import settle

SEQUENCE = 2048
SEPARATOR = 0
VOCABULARY = "byte_bpe_50k.json"
# Tokens that an emitted bin of a lower level may lack.
SLACK = 4
# Items that one task packs at a time; what they leave open joins the next ones.
ITEMS_PER_ROUND = 200_000
FAN_IN = 8
# Pieces that a task of the first level packs.
PIECES_PER_LEAF = 50_000
CACHED_PARTS = 250_000
# Characters of white space in one run that the library's pattern need not take; at about a million it gives up.
LONG_BLANK = 50_000
# What the pattern takes for white space, which is less than ``str.isspace`` does.
BLANKS = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_BLANK},}}")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Irregular(ValueError):
    """White space that must not be cut off from its surroundings."""


class Encoder:
    """Token ids as bytes, by parts that the vocabulary's own splitting never joins.

    A space before a word and a line end between words always start a part, so
    texts are cut there and the ids of parts are remembered. Texts with special
    tokens or other runs of white space are encoded whole.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        letters = byte_letters()
        ranks = {
            bytes(letters[c] for c in token): at for token, at in content["model"]["vocab"].items() if token not in special
        }
        self.bpe = tiktoken.Encoding("byte level", pat_str=public_pattern(), mergeable_ranks=ranks, special_tokens=special)
        self.special = list(special)
        self.parts = Bounded(self.encode_part, CACHED_PARTS)

    def encode_part(self, part: str) -> bytes:
        inner = part[1:] if part[:1] == " " else part
        if part != "\n" and (not inner or inner[0].isspace() or inner[-1].isspace()):
            raise Irregular
        return array("I", self.bpe.encode_ordinary(part)).tobytes()

    def encode(self, text: str) -> bytes:
        """Long runs of white space go past the pattern, which makes one piece of them but for the blank before a word."""
        out, at = [], 0
        for run in BLANKS.finditer(text) if len(text) >= LONG_BLANK else ():
            end = run.end()
            if end < len(text) and not text.startswith(tuple(self.special), end):
                end -= 1
            ids = self.bpe._encode_single_piece(text[run.start() : end].encode())
            out += self.encode_between(text[at : run.start()]), array("I", ids).tobytes()
            at = end
        return b"".join([*out, self.encode_between(text[at:])])

    def encode_between(self, text: str) -> bytes:
        if not text:
            return b""
        if "\0" not in text and not any(s in text for s in self.special):
            try:
                parts = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
                return b"".join(map(self.parts.__getitem__, parts))
            except Irregular:
                pass
        return array("I", self.bpe.encode(text, allowed_special="all")).tobytes()


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens: full ones after a first one that takes the rest."""
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def token_pieces(docs: DataFrame, size: int, separator: int, path: str | None) -> DataFrame:
    """One row for each piece of each document."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path or public_path(VOCABULARY))
        end = separator.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(*batch.columns):
                ids = memoryview(own.encode(text.as_py()) + end)
                for piece, (start, length) in enumerate(pieces_of(len(ids) // 4, size)):
                    rows.append((doc_id.as_py(), piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            if rows:
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(tasks, PIECES)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Places of the items of each bin: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r is set if a bin has room for exactly r
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = size, len(bins)
            bins.append([item])
        by_room[room - need].append(at)
        rooms |= 1 << (room - need)
    return bins


PACKED = f"{PIECES}, sequence_id long, offset long, open boolean, filled long"


def pack_tasks(size: int, slack: int, level: int):
    """Packs the items of a task in rounds. An item is a run of rows with one ``sequence_id`` and stays whole."""

    def packed(df: pd.DataFrame, base: int) -> pd.DataFrame:
        _, at, item = np.unique(df["sequence_id"], return_index=True, return_inverse=True)
        lengths = np.bincount(item, weights=df["length"]).astype(np.int64)
        bins = best_fit(lengths, size)
        bin_of, shift = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for number, items in enumerate(bins):
            bin_of[items] = number
            shift[items] = np.cumsum(lengths[items]) - lengths[items]
        filled = np.bincount(bin_of, weights=lengths)
        return df.assign(
            sequence_id=base + bin_of[item],
            offset=df["offset"] + shift[item],
            open=(filled < size - slack)[bin_of][item],
            filled=filled[bin_of][item].astype(np.int64),
        )

    def tasks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Level, task and number within the task make a bin's id; level 0 is that of the pieces.
        base, held = level + 1 << 58 | TaskContext.get().partitionId() << 36, []
        for df in frames:
            held.append(df)
            if sum(map(len, held)) < ITEMS_PER_ROUND:
                continue
            rows = pd.concat(held)
            # The last item may have more rows in the next frame.
            last = rows["sequence_id"] == rows["sequence_id"].iloc[-1]
            held = [rows]
            if last.all():
                continue
            out = packed(rows[~last], base)
            base += len(out)
            # Open bins go on with the rows to come, unless there are too many to gain from that.
            wait = out["open"] & (out["open"].sum() < ITEMS_PER_ROUND // 2)
            held = [out[wait], rows[last]]
            yield out[~wait]
        if held:
            yield packed(pd.concat(held), base)

    return tasks


def may_meet(left: DataFrame, size: int) -> DataFrame:
    """Marks open rows, as ``meets``: those of bins no more than half full, and of as many others with the most room.

    The driver gets one count for each length that open bins have.
    """
    # A bin's first row stands for it.
    bins = left.where("offset = 0").groupBy("filled").agg(F.count("*").alias("n")).collect()
    small = sum(r["n"] for r in bins if 2 * r["filled"] <= size)
    most, missing = size // 2, small
    share = 1.0
    for r in sorted((r for r in bins if 2 * r["filled"] > size), key=lambda r: r["filled"]):
        if missing <= 0:
            break
        most, share, missing = r["filled"], min(1.0, 2 * missing / r["n"]), missing - r["n"]
    # Of the fullest length that is needed about twice as many as are missing, by hash.
    some = F.pmod(F.xxhash64("sequence_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    return left.withColumn("meets", (F.col("filled") < most) | (F.col("filled") == most) & some | (2 * F.col("filled") <= size))


def packed(
    docs: DataFrame,
    size: int = SEQUENCE,
    separator: int = SEPARATOR,
    path: str | None = None,
    slack: int = SLACK,
) -> DataFrame:
    """All pieces with their ``sequence_id`` and ``offset``.

    Leaves take ``PIECES_PER_LEAF`` pieces, a task above them what ``FAN_IN``
    tasks left open. ``slack`` is what a bin may lack that is emitted early.
    """
    pieces = settle(token_pieces(docs, size, separator, path), "pieces")
    rows = pieces.select(
        "*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("open")
    )
    tasks, level, done = -(-pieces.count() // PIECES_PER_LEAF) or 1, 0, []
    rows = rows.repartition(tasks)
    while True:
        packed_rows = settle(rows.mapInPandas(pack_tasks(size, slack, level), PACKED), "packed")
        if tasks == 1:
            done.append(packed_rows)
            break
        left = may_meet(packed_rows.where("open"), size)
        done += [packed_rows.where("not open"), left.where("not meets").drop("meets")]
        tasks, level = -(-tasks // FAN_IN), level + 1
        parent = F.shiftright(F.col("sequence_id").bitwiseAND((1 << 58) - 1), 36) % tasks
        rows = left.where("meets").drop("meets", "filled").repartitionById(tasks, parent.cast("int"))
        rows = rows.sortWithinPartitions("sequence_id", "offset")
    return reduce(DataFrame.unionByName, done).drop("open", "filled")
