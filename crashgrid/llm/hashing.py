"""64-bit hashes of words and word n-grams as arrays."""

from __future__ import annotations

from functools import cache

import numpy as np

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@cache
def _letters() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


@cache
def _powers(inverse: bool, size: int) -> np.ndarray:
    """Powers of the base, or of its inverse, modulo 2^64."""
    table = np.full(size, pow(_BASE, -1, 1 << 64) if inverse else _BASE, np.uint64)
    table[0] = 1
    return np.cumprod(table, dtype=np.uint64)


@cache
def _is_blank() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def words(data: bytes) -> np.ndarray:
    """Hash of every word of a text: runs of bytes other than blanks."""
    out, at = [], 0
    letters = np.frombuffer(data, np.uint8)
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):  # a block ends with a blank if it has one
            blanks = np.flatnonzero(_is_blank()[letters[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:
                rest = np.flatnonzero(_is_blank()[letters[end:]])
                end = end + int(rest[0]) if len(rest) else len(data)
        out.append(_block_words(letters[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _block_words(letters: np.ndarray) -> np.ndarray:
    n = len(letters)
    size = BLOCK if n <= BLOCK else n
    word = ~_is_blank()[letters]
    edge = np.diff(np.r_[False, word, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_letters()[letters] * _powers(False, size)[:n], out=sums[1:])
    return mixed((sums[end] - sums[start]) * _powers(True, size)[start])


def shingles(data: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; with fewer words, of all words at once."""
    found = words(data)
    if not len(found):
        return found
    n = min(n, len(found))
    size = len(found) - n + 1
    out = np.full(size, np.uint64(n))
    for i in range(n):
        out = out * _FOLD + found[i : i + size]
    return np.unique(mixed(out))
