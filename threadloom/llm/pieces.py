"""SentencePiece encoding and decoding that keeps where each piece comes from.

A text is normalised prefix by prefix: at each place the longest prefix that the
model's compiled character map knows gives way to its replacement, any other
character stays. Every normalised byte remembers at which byte of the source its
prefix began (the alignment). Blanks become the visible blank, one of which the
model may put in front. The normalised text is encoded, and since every piece is
a stretch of normalised bytes, the alignment at its two ends gives its span of
bytes in the source.

Pieces are merged pair by pair, the best score first, of equal ones the leftmost.
Merging never crosses a border between two characters that stand together in no
piece, so a text is cut there, and what recurs between the cuts is remembered up
to a bound. Characters without a piece are spelled as bytes; the last of these
carries the character's span, the others are empty.

Models of the kind "BPE" with byte pieces and without symbols of the user are
read; others are refused. Null texts count as empty: begin and end ids only, an
empty decoded text. Texts of any length are taken whole; time grows in proportion
to the text (with a logarithm for stretches that have no cut). Rows stay in the
task that read them: there is no shuffle.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.common import whole_text
from threadloom.llm.words import Bounded, public_path

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
CACHED_CHUNKS = 600_000
CACHED_PIECES = 100_000
# Longer stretches are merged with a heap instead of a scan for the best pair.
SCANNED = 48

# Fixed values of the model format: field numbers and kinds of pieces.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL_KIND, BYTE_FALLBACK, BLANKS_BEHIND, UNKNOWN_SURFACE, BEGIN_PIECE, END_PIECE = 3, 35, 24, 44, 46, 47
CHARACTER_MAP, DUMMY_PREFIX, REMOVE_EXTRA_BLANKS, ESCAPE_BLANKS = 2, 3, 4, 5
BPE = 2


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        field, wire = divmod(number(), 8)
        if wire == 0:
            yield field, number()
        else:
            size = {1: 8, 5: 4}[wire] if wire != 2 else number()
            yield field, message[at : at + size]
            at += size


def undecodable(error: UnicodeDecodeError) -> tuple[str, int]:
    """One replacement character for each byte that belongs to no character."""
    return "�" * (error.end - error.start), error.end


codecs.register_error("threadloom-bytewise", undecodable)


class CharacterMap:
    """A compiled character map: a double-array trie over source prefixes, and a pool of their replacements."""

    def __init__(self, compiled: bytes) -> None:
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units: list[int] = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.pool = compiled[4 + size :]
        self.first = bytes(b for b in range(256) if self.units and self.child(0, b) is not None)
        # Stretches of bytes that begin no prefix stay as they are; a later byte of a character never begins one.
        self.known = re.compile(b"[" + re.escape(self.first) + b"]") if self.first else None

    def offset(self, unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def child(self, node: int, byte: int) -> int | None:
        """The place of the child by ``byte``; ``node`` is the place of its parent."""
        at = node ^ self.offset(self.units[node]) ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, source: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix from ``at`` on, and the prefix's end."""
        node, found, end = 0, None, 0
        for i in range(at, len(source)):
            node = self.child(node, source[i])
            if node is None:
                break
            unit = self.units[node]
            if unit >> 8 & 1:
                found, end = self.units[node ^ self.offset(unit)] & 0x7FFFFFFF, i + 1
        if found is None:
            return None
        return self.pool[found : self.pool.index(b"\0", found)], end

    def mapped(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end the source byte at which its prefix began."""
        if self.known is None:
            return source, np.arange(len(source) + 1)
        out, align, at = [], [], 0
        while at < len(source):
            hit = self.known.search(source, at)
            plain = hit.start() if hit else len(source)
            if plain > at:
                self.keep(source, at, plain, out, align)
                at = plain
                continue
            found = self.longest(source, at)
            if found is None:
                end = at + 1
                while end < len(source) and source[end] & 0xC0 == 0x80:
                    end += 1
                self.keep(source, at, end, out, align)
            else:
                replacement, end = found
                out.append(replacement)
                align.append(np.full(len(replacement), at))
            at = end
        return b"".join(out), np.concatenate([*align, [len(source)]]).astype(np.int64)

    def keep(self, source: bytes, at: int, end: int, out: list[bytes], align: list[np.ndarray]) -> None:
        """Characters that stay: each of their bytes points at the character's first one."""
        own = np.frombuffer(source, np.uint8, end - at, at)
        starts = np.where(own & 0xC0 != 0x80, np.arange(at, end), 0)
        out.append(source[at:end])
        align.append(np.maximum.accumulate(starts))


class Model:
    def __init__(self, content: bytes) -> None:
        self.texts: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict[int, int | bytes] = {}
        normalizer: dict[int, int | bytes] = {}
        for field, value in fields(content):
            if field == PIECES:
                piece = dict(fields(value))
                self.texts.append(piece[PIECE_TEXT].decode())
                self.kinds.append(piece.get(PIECE_KIND, NORMAL))
                scores.append(struct.unpack("<f", piece.get(PIECE_SCORE, bytes(4)))[0])
            elif field == TRAINER:
                trainer = dict(fields(value))
            elif field == NORMALIZER:
                normalizer = dict(fields(value))
        if trainer.get(MODEL_KIND) != BPE or not trainer.get(BYTE_FALLBACK) or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only BPE models with byte pieces and without symbols of the user are read")
        if trainer.get(BLANKS_BEHIND) or not normalizer.get(ESCAPE_BLANKS, 1):
            raise ValueError("only models that write blanks before words, as visible blanks, are read")
        self.map = CharacterMap(normalizer.get(CHARACTER_MAP, b""))
        self.prefix = bool(normalizer.get(DUMMY_PREFIX, 1))
        self.trim = bool(normalizer.get(REMOVE_EXTRA_BLANKS, 1))
        self.unknown_surface = trainer.get(UNKNOWN_SURFACE, b" \xe2\x81\x87 ").decode()
        of = {text: i for i, text in enumerate(self.texts)}
        self.begin = of[trainer.get(BEGIN_PIECE, b"<s>").decode()]
        self.end = of[trainer.get(END_PIECE, b"</s>").decode()]
        self.byte_ids = [of[f"<0x{b:02X}>"] for b in range(256)]
        self.byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == NORMAL}
        # The rank of a piece by its score; equal scores have equal ranks.
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {t: order[scores[i]] for t, i in self.ids.items()}
        self.never = len(order)
        # By two neighbours, the rank of the piece that they make.
        self.joins: dict[str, dict[str, int]] = {}
        self.no_joins: dict[str, int] = {}
        for text, rank in self.rank.items():
            for cut in range(1, len(text)):
                # Only characters and pieces ever stand next to each other.
                if all(len(part) == 1 or part in self.rank for part in (text[:cut], text[cut:])):
                    self.joins.setdefault(text[:cut], {})[text[cut:]] = rank
        self.pairs = {p for t in self.ids for p in zip(t, t[1:])}
        # A visible blank follows no other character inside a piece, or texts can't be cut before it.
        self.blank_first = not any(b == BLANK and a != BLANK for a, b in self.pairs)
        self.chunks = Bounded(self.encode_chunk, CACHED_CHUNKS)
        self.pieces = Bounded(self.spelled, CACHED_PIECES)

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The text that is encoded, and for each of its bytes and its end the place in the source's bytes."""
        source = text.encode("utf-8", "replace")
        if not source:
            return "", np.zeros(1, np.int64)
        first = self.leading(source) if self.trim else 0
        if first == len(source):
            return "", np.zeros(1, np.int64)
        mapped, align = self.map.mapped(source)
        own = np.frombuffer(mapped, np.uint8)
        if self.trim:
            # Of blanks in a row the first stays, at the start of the text none does.
            blank = own == 32
            kept = np.flatnonzero(~blank | np.append(False, ~blank[:-1])[: len(blank)])
            own, align = own[kept], np.append(align[kept], align[-1])
        align = np.repeat(align, np.append(np.where(own == 32, 3, 1), 1))
        normal = own.tobytes().decode("utf-8").replace(" ", BLANK)
        if self.prefix:
            normal, align = BLANK + normal, np.concatenate([np.full(3, first), align])
        if self.trim:
            normal = normal.rstrip(BLANK)
            align = align[: len(normal.encode("utf-8")) + 1]
        return normal, align

    def leading(self, source: bytes) -> int:
        """How many bytes at the start are blanks, or mapped to one."""
        at = 0
        while at < len(source):
            found = self.map.longest(source, at) if self.map.units else None
            replacement, end = found or (source[at : at + 1], at + 1)
            if replacement != b" ":
                break
            at = end
        return at

    def merged(self, symbols: list[str]) -> list[str]:
        """Neighbours joined, the best piece first, of equal ones the leftmost."""
        joins, none, never = self.joins, self.no_joins, self.never
        found = [joins.get(a, none).get(b, never) for a, b in zip(symbols, symbols[1:])]
        while found:
            best = min(found)
            if best == never:
                break
            i = found.index(best)
            both = symbols[i] = symbols[i] + symbols[i + 1]
            del symbols[i + 1], found[i]
            if i:
                found[i - 1] = joins.get(symbols[i - 1], none).get(both, never)
            if i < len(found):
                found[i] = joins.get(both, none).get(symbols[i + 1], never)
        return symbols

    def merged_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap and links between the symbols that are left."""
        n, rank = len(symbols), self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, str]] = []

        def propose(i: int, j: int) -> None:
            both = symbols[i] + symbols[j]
            if both in rank:
                heapq.heappush(heap, (rank[both], i, j, both))

        for i in range(n - 1):
            propose(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or after[i] != j or len(symbols[i]) + len(symbols[j]) != len(both):
                continue
            symbols[i], symbols[j] = both, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                propose(i, after[i])
            if before[i] >= 0:
                propose(before[i], i)
        return [s for s in symbols if s]

    def spelled(self, piece: str) -> tuple[bytes, bytes, bytes]:
        """Ids and lengths as 32-bit numbers, and decoded bytes, of what merging leaves: a piece, or a character without one."""
        raw = piece.encode("utf-8")
        if piece in self.ids:
            return struct.pack("<I", self.ids[piece]), struct.pack("<I", len(raw)), piece.replace(BLANK, " ").encode("utf-8")
        lengths = [0] * (len(raw) - 1) + [len(raw)]
        return struct.pack(f"<{len(raw)}I", *[self.byte_ids[b] for b in raw]), struct.pack(f"<{len(raw)}I", *lengths), raw

    def encode_chunk(self, chunk: str) -> tuple[bytes, bytes, bytes]:
        """Ids and lengths of a word with the blanks before it as 32-bit numbers, and its decoded bytes.

        Words of letters are seldom cut by anything, so they are merged whole.
        """
        if not chunk[1:].isalpha():
            pairs = self.pairs
            cuts = [i for i, pair in enumerate(zip(chunk, chunk[1:]), 1) if pair not in pairs]
            if cuts:
                found = [self.chunks[chunk[a:b]] for a, b in zip([0, *cuts], [*cuts, len(chunk)])]
                return tuple(map(b"".join, zip(*found)))
        symbols = list(chunk)
        left = self.merged(symbols) if len(symbols) <= SCANNED else self.merged_long(symbols)
        return tuple(map(b"".join, zip(*map(self.pieces.__getitem__, left))))

    def encode_normalised(self, text: str) -> tuple[bytes, bytes, bytes]:
        if not text:
            return b"", b"", b""
        chunks = CHUNKS.findall(text) if self.blank_first else [text]
        return tuple(map(b"".join, zip(*map(self.chunks.__getitem__, chunks))))

    def encode(self, text: str) -> tuple[bytes, np.ndarray, bytes]:
        """Ids with begin and end as bytes, the span of each in the source's bytes, and the decoded text's bytes."""
        normal, align = self.normalised(text)
        ids, lengths, decoded = self.encode_normalised(normal)
        places = np.frombuffer(lengths, "<u4").cumsum()
        ends = align[places]
        starts = align[places - np.frombuffer(lengths, "<u4")]
        source = len(text.encode("utf-8", "replace"))
        spans = np.stack([np.concatenate([[0], starts, [source]]), np.concatenate([[0], ends, [source]])], 1)
        ids = struct.pack("<I", self.begin) + ids + struct.pack("<I", self.end)
        # The blank that was put in front, or one like it.
        return ids, spans, decoded[1:] if (self.prefix or self.trim) and decoded[:1] == b" " else decoded

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: bytes are put together, the first blank goes if the model puts one in front."""
        out, run, strips, seen = [], [], self.prefix or self.trim, False

        def close() -> None:
            """Bytes without another id between them are characters, or none."""
            if run:
                out.append(b"".join(run).decode("utf-8", "threadloom-bytewise"))
                run.clear()

        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                run.append(self.byte_of[i])
                continue
            close()
            strips = strips and not seen and not out
            if kind == CONTROL:
                continue
            text = self.texts[i] if kind != UNKNOWN else self.unknown_surface
            if strips and kind != UNKNOWN and text.startswith(BLANK):
                text, seen = text.lstrip(BLANK) if self.trim else text[1:], not self.trim
            if text:
                out.append(text.replace(BLANK, " "))
        close()
        return "".join(out)


CHUNKS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


@cache
def model(path: str) -> Model:
    with open(path, "rb") as file:
        return Model(file.read())


ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, the ids of each text, the span of each id in the bytes of the text, and the text decoded from them."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path or public_path(MODEL))
        for batch in batches:
            found = [own.encode(t.as_py()) for t in batch.column(1)]
            ints = pa.list_(pa.int32())
            columns = [
                batch.column(0),
                pa.array([np.frombuffer(ids, "<i4") for ids, _, _ in found], ints),
                pa.array([spans[:, 0].astype(np.int32) for _, spans, _ in found], ints),
                pa.array([spans[:, 1].astype(np.int32) for _, spans, _ in found], ints),
                pa.array([decoded.decode("utf-8") for _, _, decoded in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ENCODED.split(", ")])

    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return texts.mapInArrow(tasks, ENCODED)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens`` and digests of the ids, of the decoded text and of the spans (pairs of 32-bit numbers)."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path or public_path(MODEL))
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids, spans, decoded = own.encode(text.as_py())
                rows.append((len(ids) // 4, *[hashlib.sha256(x).hexdigest() for x in (ids, decoded, spans.astype("<u4").tobytes())]))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = [batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in DIGESTS.split(", ")])

    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return texts.mapInArrow(tasks, DIGESTS)
