"""Fingerprints of documents as invertible Bloom lookup tables.

A text is a set of paragraph digests. A table has a few cells; every digest goes into one
cell of each of three parts, which keep a count, the exclusive or of the digests and that
of their check sums. Tables of two versions are subtracted cell by cell: what both have
cancels out, and peeling cells that hold a single digest recovers what differs. If
peeling gets stuck, there are too many differences, and both tables are built again with
twice the cells. The number of differences gives the likeness of the two texts.

Paragraphs are lines; a long one is cut into blocks of words, so that a change at its end
leaves its beginning alike. A paragraph that recurs counts with its number of occurrence.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrid.llm.hashing import mixed
from crashgrid.llm.texts import BATCH_BYTES, read, text_column

CELLS, PARTS = 24, 3
#: Least digests of two sets from which the number of differences is estimated.
ESTIMATE = 32
WORDS_PER_BLOCK = 16
_SEEDS = np.array([[i * 0x632BE59BD9B4E019 & (1 << 64) - 1] for i in range(PARTS)], np.uint64)
_CHECK = np.uint64(77)


def paragraphs(text: str) -> list[str]:
    """Lines with a word, long ones in blocks of words."""
    out = []
    for line in text.split("\n"):
        words = line.split()
        for at in range(0, len(words), WORDS_PER_BLOCK):
            out.append(" ".join(words[at : at + WORDS_PER_BLOCK]))
    return out


def digests(text: str) -> np.ndarray:
    """Distinct digests of the paragraphs, with the exact text as one more.

    The last one tells texts apart that differ in white space only.
    """
    seen: dict[str, int] = defaultdict(int)
    found = [hashlib.blake2b(b"\0" + text.encode(), digest_size=8).digest()]
    for p in paragraphs(text):
        key = f"{seen[p]} {p}" if seen[p] else p
        seen[p] += 1
        found.append(hashlib.blake2b(key.encode(), digest_size=8).digest())
    return np.unique(np.frombuffer(b"".join(found), "<u8"))


class Table:
    """Cells of a set of digests: ``count``, ``keys`` and ``checks``."""

    def __init__(self, cells: int, keys: np.ndarray | None = None):
        self.cells = cells
        self.count = np.zeros(cells, np.int64)
        self.keys, self.checks = np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
        if keys is not None:
            self.add(keys, np.ones(len(keys), np.int64))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Cells of each key, one part after the other."""
        size = self.cells // PARTS
        found = mixed(keys[None, :] + _SEEDS) % np.uint64(size)
        return (found.astype(np.int64) + np.arange(PARTS)[:, None] * size).ravel()

    def add(self, keys: np.ndarray, count: np.ndarray, at: np.ndarray | None = None) -> None:
        at = self.places(keys) if at is None else at
        three = np.concatenate([keys] * PARTS)
        self.count += np.bincount(at, np.concatenate([count] * PARTS), self.cells).astype(np.int64)
        np.bitwise_xor.at(self.keys, at, three)
        np.bitwise_xor.at(self.checks, at, mixed(three ^ _CHECK))

    def minus(self, other: Table) -> Table:
        out = Table(self.cells)
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Digests with count 1 and with count -1, or None if some cannot be recovered."""
        plus, minus = [], []
        for _ in range(self.cells + 1):
            single = np.flatnonzero(np.abs(self.count) == 1)
            single = single[self.checks[single] == mixed(self.keys[single] ^ _CHECK)]
            if not len(single):
                break
            keys, first = np.unique(self.keys[single], return_index=True)
            single = single[first]
            signs, at = self.count[single], self.places(keys)
            # A digest must lie in the cell it was found in.
            if not (at.reshape(PARTS, -1) == single).any(axis=0).all():
                return None
            plus.append(keys[signs == 1])
            minus.append(keys[signs == -1])
            self.add(keys, -signs, at)
        if self.count.any() or self.keys.any() or self.checks.any():
            return None
        none = np.zeros(0, np.uint64)
        return np.concatenate([none, *plus]), np.concatenate([none, *minus])

    def text(self, items: int) -> str:
        parts = [np.array([items], "<u4"), self.count.astype("<i4"), self.keys.astype("<u8"), self.checks.astype("<u4")]
        return base64.b64encode(b"".join(p.tobytes() for p in parts)).decode()


def expected_differences(one: np.ndarray, other: np.ndarray) -> float:
    """Estimate from the least digests of both (sorted) sets."""
    first, second = set(one[:ESTIMATE].tolist()), set(other[:ESTIMATE].tolist())
    least = sorted(first | second)[:ESTIMATE]
    if not least:
        return 0.0
    share = sum(x in first and x in second for x in least) / len(least)
    return (1 - share) / (1 + share) * (len(one) + len(other))


def difference(one: np.ndarray, other: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Digests only in ``one`` and only in ``other``, from tables of growing size.

    The first tables have room for the expected differences.
    """
    room = max(2 * expected_differences(one, other), abs(len(one) - len(other)))
    while cells < room:
        cells *= 2
    while True:
        found = Table(cells, one).minus(Table(cells, other)).peel()
        if found is not None:
            return found
        cells *= 2


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Jaccard similarity of two sets of digests."""
    only, new = difference(one, other)
    union = (len(one) + len(other) + len(only) + len(new)) / 2
    return 1.0 if not union else 1.0 - (len(only) + len(new)) / union


def fingerprint(keys: np.ndarray, cells: int = CELLS) -> str:
    return Table(cells, keys).text(len(keys))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every text; null is read as empty."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(digests(t)) for t in texts.to_pylist()], pa.string())

    return docs.select(F.col(doc_id).alias("doc_id"), of(text_column(text)).alias("fingerprint"))


def _with_followers(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows sorted by id within partitions; ``_last`` marks copies of the row that follows.

    Ids are cut into ranges at existing ids, one per partition; rows at a cut also go to
    the range before, and the very first rows to the last range. Nulls sort first, equal
    ids by text. Only the cuts, one id per partition, come to the driver.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(doc_id).alias("id")).repartitionByRange(parts, "id")
    found = ids.groupBy(F.spark_partition_id().alias("part")).agg(
        F.min("id").alias("low"), F.sum(F.col("id").isNull().cast("int")).alias("nulls")
    ).collect()
    cuts = sorted(r.low for r in found if r.low is not None)
    nulls = any(r.nulls for r in found)
    final = max(len(cuts) - 1, 0)

    @F.arrow_udf("array<struct<bucket:int,last:boolean>>")
    def ranges(ids: pa.Array) -> pa.Array:
        out = []
        for i in ids.to_pylist():
            own = 0 if i is None else max(bisect_right(cuts, i) - 1, 0)
            places = [{"bucket": own, "last": False}]
            if i is not None and own and i == cuts[own]:
                places.append({"bucket": own - 1, "last": True})
            if i is None if nulls else i == cuts[0]:
                places.append({"bucket": final, "last": True})
            out.append(places)
        kind = pa.list_(pa.struct([("bucket", pa.int32()), ("last", pa.bool_())]))
        return pa.array(out, kind)

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_column(text).alias("text"))
    placed = rows.select("*", F.explode(ranges("doc_id")).alias("_p")).select("doc_id", "text", "_p.bucket", "_p.last")
    dealt = placed.repartitionById(final + 1, "bucket")
    return dealt.sortWithinPartitions("bucket", "last", F.asc_nulls_first("doc_id"), "text")


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited version, and likenesses.

    The edited version has the last quarter of the code points replaced by as many of the
    next document (by id; the first follows the last). Columns: ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    rows = _with_followers(docs, doc_id, text).select("doc_id", "text", "last")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held, out, size = None, [], 0
        for batch in batches:
            for ident, body, last in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                now = (ident, body, digests(body))
                if held is not None:
                    out.append(_compare(*held, *now[1:]))
                    size += 2_000
                held = None if last else now
                if size >= BATCH_BYTES:
                    yield _batch(out, batch.column(0).type, names)
                    out, size = [], 0
        if out:
            yield _batch(out, batch.column(0).type, names)

    return rows.mapInArrow(
        run,
        f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )


def _compare(ident, body: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
    quarter = len(body) // 4
    edited = body[: len(body) - quarter] + following[:quarter]
    changed = digests(edited)
    return (
        ident,
        len(body),
        hashlib.sha256(edited.encode()).hexdigest(),
        fingerprint(own),
        fingerprint(changed),
        likeness(own, changed),
        likeness(own, its),
    )


def _batch(rows: list[tuple], id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op3_lookup_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compared(read(spark, sf_dir))
