"""Vocabulary files of public tokenizers, and a bounded cache for what recurs in texts."""

from __future__ import annotations

from collections.abc import Callable

LONGEST_KEY = 64


class Bounded(dict):
    """Computes missing values and keeps at most ``2 * limit`` of them: those used since the last two turnovers.

    Values of long keys aren't kept.
    """

    def __init__(self, make: Callable, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if isinstance(key, str) and len(key) > LONGEST_KEY:
                return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def public_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def public_pattern() -> str:
    """How the byte-level vocabularies split texts."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if it is printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
