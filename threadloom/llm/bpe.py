"""Byte-pair encoding and decoding by dynamic programming over prefixes.

A vocabulary's tokens are put into one suffix automaton. Reading a word's
symbols, it gives after each one all tokens that end there. Of these exactly one
is the last token of that prefix's encoding: the one that is compatible with the
last token of the prefix before it, that is, whose merges no earlier merge across
the border would have disturbed. Each prefix stores its last token and the back
pointers give the word's ids, the same as merging pairs by rank gives.

Words are found as the vocabulary file says: special tokens as they are,
otherwise composed, lower-cased, split into contractions, runs of letters, single
digits and runs of other signs; white space is dropped. Decoding joins the
tokens' strings with spaces, as there is no decoder in the file.

Null texts count as empty: no ids, an empty decoded text. Words of any length
take time in proportion to their length; what recurs is remembered up to a
bound.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.common import whole_text
from threadloom.llm.words import Bounded, byte_letters, public_path

VOCABULARY = "word_bpe_49k.json"
# One for each byte inside a word, one for each byte at its end.
SYMBOLS = 512
CACHED_CHUNKS = 200_000
CACHED_WORDS = 300_000
CACHED_PAIRS = 300_000

WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
BLANKS = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# Python takes these for white space, the tokenizer does not.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


class SuffixAutomaton:
    """All substrings of the tokens; ``step`` reads a symbol, ``tokens`` are those that end at the place read."""

    def __init__(self, words: list[tuple[tuple[int, ...], int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for symbols, token in words:
            last = 0
            for s in symbols:
                last = self.extended(last, s)
            ends.append(last)
        # A copy made later may have taken over a token's string, so places are looked up once all are in.
        self.own: dict[int, list[tuple[int, int]]] = {}
        for symbols, token in words:
            state = 0
            for s in symbols:
                state = self.next[state][s]
            self.own.setdefault(state, []).append((len(symbols), token))
        for found in self.own.values():
            found.sort(reverse=True)
        # The nearest state on the way up the links that has tokens.
        self.up = [0] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            above = self.link[state]
            self.up[state] = above if above in self.own else self.up[above]

    def state(self, length: int, copied: dict[int, int], link: int) -> int:
        self.next.append(copied)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def split(self, p: int, q: int, s: int) -> int:
        """``q`` itself if it continues ``p`` by one symbol, else a copy of it that does."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self.state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(s) == q:
            self.next[p][s] = copy
            p = self.link[p]
        return copy

    def extended(self, last: int, s: int) -> int:
        if s in self.next[last]:
            return self.split(last, self.next[last][s], s)
        new, p = self.state(self.length[last] + 1, {}, 0), last
        while p >= 0 and s not in self.next[p]:
            self.next[p][s] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self.split(p, self.next[p][s], s)
        return new


class Vocabulary:
    """Tokens are numbered by their merge: symbols first, then each merge's product in order of rank."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, letters = content["model"], byte_letters()
        suffix = model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in content["added_tokens"]}
        number = {letter: b for letter, b in letters.items()} | {letter + suffix: 256 + b for letter, b in letters.items()}
        self.ids = [0] * SYMBOLS
        self.strings = [""] * SYMBOLS
        for string, at in number.items():
            self.ids[at], self.strings[at] = model["vocab"][string], string
        self.left, self.right = list(range(SYMBOLS)), list(range(SYMBOLS))
        self.merged: dict[tuple[int, int], int] = {}
        spelled: list[tuple[int, ...]] = [(i,) for i in range(SYMBOLS)]
        for a, b in model["merges"]:
            pair, at = (number[a], number[b]), len(self.left)
            string = a + b
            number[string] = at
            self.ids.append(model["vocab"][string])
            self.strings.append(string)
            self.merged[pair] = at
            self.left.append(pair[0])
            self.right.append(pair[1])
            spelled.append(spelled[pair[0]] + spelled[pair[1]])
        # Tokens that merging yields from their own symbols; no others ever occur.
        whole = [True] * SYMBOLS
        for at in range(SYMBOLS, len(self.left)):
            a, b = self.left[at], self.right[at]
            whole.append(whole[a] and whole[b] and self.compatible(a, b, at))
        self.automaton = SuffixAutomaton([(spelled[t], t) for t in range(len(whole)) if whole[t]])
        special = "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))
        self.special = regex.compile(f"({special})") if special else None
        self.pairs = Bounded(lambda pair: self.compatible(*divmod(pair, len(self.left))), CACHED_PAIRS)
        self.words = Bounded(self.encode_word, CACHED_WORDS)
        self.chunks = Bounded(self.encode_chunk, CACHED_CHUNKS)

    def compatible(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether merging by rank never joins across the border of neighbouring tokens ``a`` and ``b``.

        Their merges are undone, the latest first. Two symbols that meet at the
        border in between must not have a merge before the one undone last; of
        equal merges the left one comes first.
        """
        limit = len(self.left) if before is None else before
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a > b:
                if a < SYMBOLS:
                    return True
                limit, a = a, self.right[a]
            else:
                if b < SYMBOLS:
                    return True
                limit, b = b + 1, self.left[b]

    def encode_word(self, word: str) -> tuple[bytes, str]:
        """Ids as bytes and the decoded tokens of a word."""
        symbols = list(word.encode("utf-8", "surrogatepass"))
        symbols[-1] += 256
        automaton, pairs, n = self.automaton, self.pairs, len(self.left)
        step, link, length, own, up = automaton.next, automaton.link, automaton.length, automaton.own, automaton.up
        last, back = [0] * (len(symbols) + 1), [0] * (len(symbols) + 1)
        state = read = 0
        for end, s in enumerate(symbols, 1):
            while s not in step[state]:
                state = link[state]
                read = length[state]
            state = step[state][s]
            read += 1
            at = state if state in own else up[state]
            found = False
            while not found:
                for size, token in own[at]:
                    if size <= read and (size == end or pairs[last[end - size] * n + token]):
                        last[end], back[end], found = token, end - size, True
                        break
                at = up[at]
        tokens, end = [], len(symbols)
        while end:
            tokens.append(last[end])
            end = back[end]
        tokens.reverse()
        return array("I", [self.ids[t] for t in tokens]).tobytes(), " ".join([self.strings[t] for t in tokens])

    def encode_chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids as bytes and the decoded tokens of a text without white space."""
        found = []
        for part in self.special.split(chunk) if self.special else [chunk]:
            if part in self.specials:
                found.append((array("I", [self.specials[part]]).tobytes(), part))
                continue
            part = unicodedata.normalize("NFC", part)
            part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
            for word in WORDS.findall(part):
                found.append(self.words[word])
        return found[0] if len(found) == 1 else (b"".join([i for i, _ in found]), " ".join([s for _, s in found]))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit numbers, and the text that decoding them gives."""
        plain = not any(s in text for s in SEPARATORS)
        chunks = text.split() if plain else [c for c in BLANKS.split(text) if c]
        found = list(map(self.chunks.__getitem__, chunks))
        return b"".join([ids for ids, _ in found]), " ".join([s for _, s in found])


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, the ``ids`` of each text and the text ``decoded`` from them."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path or public_path(VOCABULARY))
        for batch in batches:
            found = [own.encode(t.as_py()) for t in batch.column(1)]
            ids = [np.frombuffer(b, "<u4").astype(np.int32) for b, _ in found]
            columns = [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([d for _, d in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return texts.mapInArrow(tasks, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the digests of the ids and of the decoded text, without moving either."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path or public_path(VOCABULARY))
        for batch in batches:
            n, ids_digest, text_digest = [], [], []
            for text in batch.column(1):
                ids, decoded = own.encode(text.as_py())
                n.append(len(ids) // 4)
                ids_digest.append(hashlib.sha256(ids).hexdigest())
                text_digest.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return texts.mapInArrow(tasks, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
