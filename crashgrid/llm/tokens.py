"""Hashed terms of many texts at once.

A term is a maximal run of ASCII letters and digits and of characters beyond ASCII; only
A-Z is lower-cased. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from crashgrid.llm.hashing import mixed

#: Bytes hashed at once; a longer run without a boundary is hashed whole.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to terms, and the random number of each byte."""
    inside = np.zeros(256, bool)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        inside[low : high + 1] = True
    numbers = np.random.default_rng(29).integers(1, 1 << 63, 256, dtype=np.uint64)
    numbers[0x41:0x5B] = numbers[0x61:0x7B]
    return inside, numbers


def _powers_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    tables = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.full(size, base, np.uint64)
        table[0] = 1
        tables.append(np.cumprod(table, dtype=np.uint64))
    return tuple(tables)


@cache
def _piece_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(PIECE)


def _cuts(inside: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end where no term goes on."""
    at, n = 0, len(inside)
    while at < n:
        end = min(at + PIECE, n)
        if end < n:
            free = np.flatnonzero(~inside[at:end] | first[at:end])
            if len(free) and free[-1]:
                end = at + int(free[-1])
            else:
                rest = np.flatnonzero(~inside[end:] | first[end:-1])
                end = end + int(rest[0]) if len(rest) else n
        yield at, end
        at = end


def term_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms in order, and how many terms each text has. No nulls."""
    texts = texts.cast(pa.large_binary())
    _, offset_bytes, body = texts.buffers()
    offsets = np.frombuffer(offset_bytes, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    offsets = offsets - low
    data = np.frombuffer(body, np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    is_term, numbers = _tables()
    inside = is_term[data]
    first = np.zeros(len(data) + 1, bool)  # a text begins here
    first[offsets] = True
    hashes, starts = [], []
    for at, end in _cuts(inside, first):
        part = inside[at:end]
        size = end - at
        goes_on = part[:-1] & part[1:] & ~first[at + 1 : end]
        begin, stop = part.copy(), part.copy()
        begin[1:] &= ~goes_on
        stop[:-1] &= ~goes_on
        begin, stop = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        powers, inverse = _piece_powers() if size <= PIECE else _powers_of(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(numbers[data[at:end]] * powers[:size], out=sums[1:])
        hashes.append(mixed((sums[stop] - sums[begin]) * inverse[begin]))
        starts.append(begin + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), offsets))


def blocks(batches: Iterator[pa.RecordBatch], column: str, most_texts: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches of at most ``most_texts`` rows and about ``most_bytes`` of text, one text at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.r_[0, np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))]
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(sizes, sizes[at] + most_bytes, "right")) - 1
            end = min(max(end, at + 1), at + most_texts, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values, one for each slice of ``values`` that ends at one of ``ends``."""
    offsets = np.r_[0, ends].astype(np.int64) * values.itemsize
    if offsets[-1] >= 1 << 31:
        raise ValueError("a block is too large")
    return pa.Array.from_buffers(
        pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]
    )
