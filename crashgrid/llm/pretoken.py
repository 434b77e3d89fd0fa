"""Pre-tokens of byte-level BPE by array operations, and a bounded cache over them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import regex

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@cache
def _classes() -> np.ndarray:
    """Class of every code point, as the pattern's library sees it."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, expr in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = "".join(regex.findall(expr, points)).encode("utf-32-le")
        table[np.frombuffer(found, "<u4")] = kind
    return table


def starts(text: str) -> np.ndarray:
    """Start positions of the matches of the public pattern in a text, in code points.

    The pattern takes contractions, then runs of letters, of numbers or of other signs,
    each with one space before it if there is one, then white space; white space before
    other characters leaves its last character to them.
    """
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    space = kind == SPACE
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    # White space followed by anything else: its last character starts a match ...
    last = space[:-1] & ~space[1:]
    start[:-1] |= last
    # ... which goes on into the next run if it is a plain space.
    start[1:] &= ~(last & (points[:-1] == 32))
    quotes = np.flatnonzero((points == 39) & start)
    for q in quotes.tolist():
        if not start[q]:
            continue
        tail = text[q + 1 : q + 3]
        size = 2 if tail[:1] in ("s", "t", "m", "d") and tail else 3 if tail in ("re", "ve", "ll") else 0
        if size:
            start[q + 1] = False
            if q + size < n:
                if size == 3:
                    start[q + 2] = False
                if kind[q + size] != SPACE or points[q + size] != 32:
                    start[q + size] = True
    return np.flatnonzero(start)


def split(text: str) -> list[str]:
    """The matches of the public pattern, in order."""
    if not text:
        return []
    at = starts(text).tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]


class WordCache(dict):
    """``cache[word]`` computes once and keeps up to ``limit`` results of short words."""

    def __init__(self, compute: Callable[[str], object], limit: int = 400_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, word: str):
        value = self.compute(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value
