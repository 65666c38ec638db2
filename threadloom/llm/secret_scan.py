"""Secret scans: fixed patterns, and values in credential context whose password would be hard to guess.

The guess cost of a value is the logarithm of the guesses that the cheapest
segmentation takes: dynamic programming over its ends chooses among words of a
frequency-ordered list, dates, repeats, keyboard walks, sequences and
brute-force spans, each of them wherever it may begin and end (a walk, sequence or
repeat of more than ``LONGEST_PART`` characters only from the start of its longest
run). A value after a credential word (``pwd``, ``auth``,
``bearer`` and the like) counts as a secret from ``MIN_COST`` on; spans of the
fixed patterns stay whatever they cost, their costs are reported.

Null texts count as empty. Values of any length take time in proportion to it.
Repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.common import whole_text
from threadloom.llm.words import public_path

# The patterns of the base kinds, in order.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED, MIN_ACCESS = 6, 20

CONTEXT = re.compile(
    r"(?<![a-z])(?:pwd|pass(?:word|wd|phrase|code)?|secret|token|api_?key|auth|bearer|credentials?|private_?key|access_?key)"
    r"""["']?\x20*(?::=|[:=]|=>|\x20is\x20|(?<=bearer)\x20)\x20*["']?([^\s"'<>,;]{6,})""",
    re.ASCII | re.IGNORECASE,
)
CREDENTIAL_WORDS = ("pwd", "pass", "secret", "token", "api", "auth", "bearer", "credential", "key")
BASE_WORDS = ("password", "passwd", "secret", "token", "api")

# Logarithm of the guesses from which a value in credential context is a secret.
MIN_COST = 8.0
# What one more segment costs, and one brute-force character.
SEGMENT_COST, CHARACTER_COST = 0.3, 1.0
LONGEST_WORD = 24
LONGEST_UNIT = 8
LONGEST_PART = 64

KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LOOKALIKES = str.maketrans("4@301!$57", "aaeoiisst")
DATE = re.compile(
    r"(?:(?:19|20)[0-9]{2}([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01]))"
    r"|(?:(?:0[1-9]|[12][0-9]|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2})"
    r"|(?:19|20)[0-9]{2}"
)
WORD_LIST = "word_bpe_49k.json"


@cache
def word_costs(path: str) -> dict[str, float]:
    """Whole words of a public vocabulary with the logarithm of their place in its order of frequency."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    end = model["end_of_word_suffix"]
    whole = (t.removesuffix(end) for t in sorted(model["vocab"], key=model["vocab"].get) if t.endswith(end))
    return {w: log10(rank + 2) for rank, w in enumerate(w for w in whole if len(w) >= 3 and w.isalpha() and w.isascii())}


@cache
def neighbours() -> dict[str, set[str]]:
    """Keys that touch on a keyboard: in the same row, or in the row above or below."""
    found: dict[str, set[str]] = {}
    for y, row in enumerate(KEY_ROWS):
        for x, key in enumerate(row):
            near = {KEY_ROWS[y + dy][x + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)
                    if 0 <= y + dy < len(KEY_ROWS) and 0 <= x + dx < len(KEY_ROWS[y + dy])}
            found[key] = near - {key}
    return found


def run_starts(n: int, reach: int, joined) -> list[int]:
    """For each end, where the longest run up to it starts: ``joined(i)`` says whether place ``i`` goes on from ``i - reach``."""
    starts, start = [0] * (n + 1), 0
    for at in range(reach, n):
        if not joined(at):
            start = at - reach + 1
        starts[at + 1] = start
    return starts


def parts(start: int, end: int, least: int) -> Iterator[int]:
    """Where the parts of a run begin that end at ``end`` and have ``least`` characters or more."""
    if end - start < least:
        return
    if end - start > LONGEST_PART:
        yield start
    yield from range(max(start, end - LONGEST_PART), end - least + 1)


def case_cost(word: str) -> float:
    upper = sum(c.isupper() for c in word)
    return 0.0 if not upper else log10(2) if upper == len(word) or (upper == 1 and word[0].isupper()) else log10(2 + upper * len(word))


def guess_cost(value: str, words: dict[str, float]) -> float:
    """The logarithm of the guesses that the cheapest segmentation of ``value`` takes."""
    n, lower = len(value), value.lower()
    if len(lower) != n:  # a letter that becomes two
        lower = value
    plain = lower.translate(LOOKALIKES)
    dates: dict[int, list[tuple[int, float]]] = {}
    for at in range(n):
        if date := DATE.match(value, at):
            dates.setdefault(date.end(), []).append((at, log10(365 * 100) if date.end() - at > 4 else log10(100)))

    near = neighbours()
    walks = run_starts(n, 1, lambda i: lower[i] in near.get(lower[i - 1], ()))
    turns = [0, 0]
    for i in range(1, n):
        turns.append(turns[-1] + (near.get(lower[i]) != near.get(lower[i - 1])))
    steps = [run_starts(n, 1, lambda i, step=step: ord(lower[i]) - ord(lower[i - 1]) == step) for step in (1, -1)]
    units = range(1, min(LONGEST_UNIT, n // 2) + 1)
    repeated = {u: run_starts(n, u, lambda i, u=u: value[i] == value[i - u]) for u in units}

    def spans(end: int) -> Iterator[tuple[int, float]]:
        """Starts and costs of the walks, sequences, repeats and dates that end here."""
        for start in parts(walks[end], end, 3):
            turned = (turns[end] - turns[start + 1]) // 4
            yield start, log10(47) + (1 + turned) * log10(5) + log10(end - start)
        for starts in steps:
            for start in parts(starts[end], end, 3):
                yield start, log10(26) + log10(end - start)
        for unit, starts in repeated.items():
            # A repeat of a shorter unit is cheaper.
            if any(unit % u == 0 and repeated[u][end] <= starts[end] for u in range(1, unit // 2 + 1)):
                continue
            for start in parts(starts[end], end, max(3, 2 * unit)):
                yield start, unit * CHARACTER_COST + log10((end - start) / unit)
        yield from dates.get(end, ())

    cost, brute = [0.0] + [0.0] * n, float("inf")
    for end in range(1, n + 1):
        brute = min(brute, cost[end - 1] + SEGMENT_COST) + CHARACTER_COST
        best = brute
        for start in range(max(0, end - LONGEST_WORD), end - 2):
            for spelled, extra in ((lower, 0.0), (plain, log10(2))):
                found = words.get(spelled[start:end])
                if found is not None:
                    best = min(best, cost[start] + SEGMENT_COST + found + extra + case_cost(value[start:end]))
                    break
        for start, own in spans(end):
            best = min(best, cost[start] + SEGMENT_COST + own)
        cost[end] = best
    return max(0.0, cost[n] - SEGMENT_COST) if n else 0.0


def base_spans(text: str, lower: str) -> list[tuple[int, int, int, str | None]]:
    """Start, kind, end and assigned value of the fixed patterns' spans, ordered."""
    found = []
    if any(w in lower for w in BASE_WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: s[:2])


def scan(text: str, words: dict[str, float], min_cost: float = MIN_COST) -> list[tuple[int, int, int, float | None]]:
    """Start, kind, end and guess cost of all spans, ordered."""
    lower = text.lower()
    base = base_spans(text, lower)
    found = [(start, kind, end, None if value is None else guess_cost(value, words)) for start, kind, end, value in base]
    if any(w in lower for w in CREDENTIAL_WORDS):
        for m in CONTEXT.finditer(text):
            start, end = m.span(1)
            if not any(s < end and start < e for s, _, e, _ in base) and (cost := guess_cost(m[1], words)) >= min_cost:
                found.append((start, 3, end, cost))
    return sorted(found, key=lambda s: s[:2])


def written(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


SCANNED = (
    "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, costs string"
)


def scanned(docs: DataFrame, path: str | None = None, min_cost: float = MIN_COST) -> DataFrame:
    """Per document the counts by kind, the digest of the base spans, all spans, and the guess costs of those with a value."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_costs(path or public_path(WORD_LIST))
        for batch in batches:
            rows = []
            for doc_id, text in zip(*batch.columns):
                found = scan(text.as_py(), words, min_cost)
                base = written([s for s in found if s[1] < 3])
                rows.append((
                    doc_id.as_py(),
                    *(sum(s[1] == kind for s in found) for kind in range(len(KINDS))),
                    hashlib.sha256(base.encode()).hexdigest(),
                    written(found),
                    ",".join(f"{s[0]}:{s[3]:.2f}" for s in found if s[3] is not None),
                ))
            names = [c.split()[0] for c in SCANNED.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.string()] * 3
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return texts.mapInArrow(tasks, SCANNED)
