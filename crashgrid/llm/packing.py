"""Pack documents into fixed-length sequences along a Hilbert curve.

The token ids of a document are hashed into a vector, projected to three coordinates
and turned into a key on a Hilbert curve, so that documents with like vocabulary get
neighbouring keys. Rows are sorted by range of key and cut one after the other into
sequences. Each range fills its own sequences; what is left at its end becomes
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrid.llm import pretoken, vocab
from crashgrid.llm.texts import give_back, read, text_column
from crashgrid.sources.storage import materialise

SEQUENCE = 2048
END_ID = 1
VECTOR = 256
DIMENSIONS, BITS = 3, 16
#: Room for sequence numbers of one range of keys.
RANGE_SHIFT = 40


@cache
def _buckets(size: int) -> np.ndarray:
    """The vector component of every token id."""
    mixed = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(56)).astype(np.int64) % VECTOR


@cache
def _directions() -> np.ndarray:
    """Projection with zero column sums, so that a document of all words lies in the middle."""
    found = np.random.default_rng(7).standard_normal((VECTOR, DIMENSIONS))
    return found - found.mean(axis=0)


def curve_position(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points, one row each, with ``bits`` bits per coordinate."""
    axes = [coordinates[:, i].astype(np.uint64) for i in range(coordinates.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        low = (one << np.uint64(level)) - one
        for i, axis in enumerate(axes):
            mirrored = (axis >> np.uint64(level)) & one == one
            swap = np.where(mirrored, 0, (axes[0] ^ axis) & low).astype(np.uint64)
            axes[0] = axes[0] ^ np.where(mirrored, low, swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(coordinates), np.uint64)
    for level in range(bits - 1, 0, -1):
        low = (one << np.uint64(level)) - one
        turn ^= np.where((axes[-1] >> np.uint64(level)) & one == one, low, np.uint64(0))
    axes = [axis ^ turn for axis in axes]
    key = np.zeros(len(coordinates), np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << one) | ((axis >> np.uint64(level)) & one)
    return key.astype(np.int64)


def curve_key(ids: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """Key of each document from its token ids."""
    table = _buckets(vocabulary)
    vectors = np.sqrt(np.array([np.bincount(table[i], minlength=VECTOR) for i in ids], float))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    place = np.tanh(vectors @ _directions())
    whole = np.floor((place + 1) / 2 * ((1 << BITS) - 1) + 0.5)
    return curve_position(whole, BITS)


def tokenised(
    docs: DataFrame, path: str, special: dict[str, int], doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID
) -> DataFrame:
    """One row per text: ``doc_id``, ``key``, ``n_tokens`` and ``ids`` (unsigned 16 or 32 bit).

    Null is read as empty; every text ends in ``end_id``.
    """
    vocabulary = max([end_id, *special.values(), *vocab.ranks(path).values()]) + 1
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_column(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], width)

    def run(batches):
        enc = vocab.encoding(path, tuple(special.items()))
        single = enc._encode_single_piece
        of = pretoken.WordCache(lambda w: np.array(single(w), width).tobytes())
        get = of.__getitem__
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                ids = []
                for body in part.column(1).to_pylist():
                    if any(s in body for s in special):
                        found = np.array(enc.encode(body, allowed_special="all"), width)
                    else:
                        found = np.frombuffer(b"".join([get(w) for w in pretoken.split(body)]), width)
                    ids.append(np.concatenate([found, end]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(curve_key(ids, vocabulary)),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([i.tobytes() for i in ids], pa.binary()),
                    ],
                    ["doc_id", "key", "n_tokens", "ids"],
                )
        of.clear()
        give_back()

    return rows.mapInArrow(run, f"doc_id {id_type}, key long, n_tokens long, ids binary")


def last_lengths(rest: int) -> list[int]:
    """Powers of two that add up to ``rest``, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(tokens: DataFrame, wide: bool = False, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of documents: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``tokens`` comes from ``tokenised``; ``wide`` says that its ids have 32 bits. Each id
    lies in one piece; offsets of a sequence have no gaps. The ids of a piece are
    little-endian unsigned 32-bit numbers.
    """
    if sequence < 1 or sequence & (sequence - 1):
        raise ValueError("the length of a sequence must be a power of two")
    id_type = tokens.schema["doc_id"].dataType.simpleString()
    width = "<u4" if wide else "<u2"

    def make():
        task = TaskContext.get().partitionId()
        return _Packer(task << RANGE_SHIFT, sequence, width)

    schema = f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    ranged = tokens.repartitionByRange("key", "doc_id", "n_tokens").sortWithinPartitions("key", "doc_id", "n_tokens")
    # A last row per range tells the packer that no document follows.
    return _map_with_end(ranged.select("doc_id", "n_tokens", "ids"), make, schema)


class _Packer:
    """Cuts a stream of documents; holds back the pieces of the sequence being filled."""

    def __init__(self, first_id: int, sequence: int, width: str):
        self.next_id, self.sequence, self.width = first_id, sequence, width
        self.open: list[tuple] = []
        self.filled = 0

    def add(self, doc, n_tokens: int, ids: bytes):
        data = np.frombuffer(ids, self.width)
        at = 0
        while at < n_tokens:
            size = min(n_tokens - at, self.sequence - self.filled)
            self.open.append((doc, at, data[at : at + size], n_tokens))
            self.filled += size
            at += size
            if self.filled == self.sequence:
                yield from self._close([self.sequence])

    def end(self):
        yield from self._close(last_lengths(self.filled))

    def _close(self, lengths: list[int]):
        pieces, self.open, self.filled = self.open[::-1], [], 0
        for length in lengths:
            offset = 0
            while offset < length:
                doc, start, data, n_tokens = pieces.pop()
                size = min(len(data), length - offset)
                if size < len(data):
                    pieces.append((doc, start + size, data[size:], n_tokens))
                yield doc, start, size, data[:size].astype("<u4").tobytes(), n_tokens, self.next_id, offset
                offset += size
            self.next_id += 1


def _map_with_end(rows: DataFrame, make, schema: str) -> DataFrame:
    target = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        from crashgrid.llm.texts import BATCH_BYTES, _to_batch

        arrow, packer, out, size = to_arrow_schema(target), make(), [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for piece in packer.add(*row):
                    out.append(piece)
                    size += 64 + len(piece[3])
                if size >= BATCH_BYTES:
                    yield _to_batch(out, arrow)
                    out, size = [], 0
        out.extend(packer.end())
        if out:
            yield _to_batch(out, arrow)

    return rows.mapInArrow(run, target)


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` packed with the public vocabulary of 50,257 ids."""
    path = vocab.default_path("byte_bpe_50k.tiktoken")
    tokens = tokenised(docs, path, {"<|endoftext|>": 50256}, doc_id, text)
    # Written once: finding the ranges and dealing the rows would each tokenise.
    return pack(materialise(tokens, "packing"))


def digest_columns(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_hilbert_packing(spark, sf_dir: str) -> DataFrame:
    return digest_columns(packed(read(spark, sf_dir)))
