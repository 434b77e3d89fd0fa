"""Remove long byte strings that occur more than once in a corpus.

A window is a string of SPAN bytes. Every window is assigned to the leftmost least hash
among its GRAM-byte strings, so equal windows meet under one key. Neighbouring windows
with the same least hash form a segment; a document becomes a few short segments, of
which only key and digest are shuffled first. A key with one segment has no repeated
window. A key whose segments are all equal strings has only repeated windows. Under the
other keys one copy of each distinct segment is fetched, and the suffix array of a key's
segments brings equal windows side by side. Keys with more bytes than GROUP_BYTES are
split into single windows, which are grouped by their hashes.

Positions are bytes of the UTF-8 text. Rows are told apart by a 128-bit hash of id and
text, so equal rows share their result.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrid.llm.suffix_array import suffix_array
from crashgrid.llm.texts import map_rows, read, text_column
from crashgrid.sources.storage import discard, materialise

SPAN, GRAM = 200, 64
#: Texts are hashed in blocks of this many bytes (places take 20 bits).
BLOCK = (1 << 20) - SPAN
GROUP_BYTES = 1 << 20
#: Bytes of segments that one task sorts, as long as these are not too many tasks.
TASK_BYTES, MOST_TASKS = 2 << 20, 100_000

_PLACE_BITS = np.uint64(20)
_BASE = 0x9E3779B97F4A7C15


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random number of each byte, powers of the base and their inverses modulo 2^64."""
    letters = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
    powers = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.full(BLOCK + SPAN + 1, base, np.uint64)
        table[0] = 1
        powers.append(np.cumprod(table, dtype=np.uint64))
    return letters, *powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Hashes:
    """Hashes of any substrings of one block, from running sums."""

    def __init__(self, data: np.ndarray):
        letters, powers, self.inverse = _tables()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all_of(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, key and digest of the segments of one block."""
    hashes = _Hashes(data)
    grams = hashes.all_of(GRAM)
    # Place in the low bits: the least value is the leftmost among equal hashes.
    least = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    width, wanted = 1, SPAN - GRAM + 1
    while width * 2 <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if wanted > width:
        least = np.minimum(least[: width - wanted], least[wanted - width :])
    start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    count = np.diff(np.r_[start, len(least)])
    place = (least[start] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    digest = hashes.of(start, start + count - 1 + SPAN)
    return start, count, grams[place].view(np.int64), digest.view(np.int64)


def _segment_rows(docs: DataFrame) -> DataFrame:
    """``_k1, _k2, at, n, key, digest`` of all segments of ``_text``."""
    schema = ["_k1", "_k2", "at", "n", "key", "digest"]

    def run(batches):
        for batch in batches:
            k1, k2, parts, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), [], 0
            for i, text in enumerate(batch.column(2).to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                for first in range(0, len(data) - SPAN + 1, BLOCK):
                    start, count, key, digest = segments(data[first : first + BLOCK + SPAN - 1])
                    n = len(start)
                    parts.append((np.full(n, k1[i]), np.full(n, k2[i]), start + first, count.astype(np.int32), key, digest))
                    rows += n
                if rows > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema)
                    parts, rows = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema)

    return docs.select("_k1", "_k2", "_text").mapInArrow(
        run, "_k1 long, _k2 long, at long, n int, key long, digest long"
    )


def repeated_windows(strings: list[bytes]) -> list[np.ndarray]:
    """Per string the starts of windows that also start elsewhere in the strings.

    Only stretches whose windows have a hash that occurs twice are sorted: equal windows have
    equal hashes. Whether windows are equal is decided on their bytes.
    """
    hashes = [_Hashes(np.frombuffer(s, np.uint8)).all_of(SPAN) for s in strings]
    _, which, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    twice = np.split(counts[which] > 1, np.cumsum([len(h) for h in hashes])[:-1])
    pieces, places = [], []
    for i, flags in enumerate(twice):
        edges = np.flatnonzero(np.diff(np.r_[False, flags, False])).tolist()
        for low, high in zip(edges[::2], edges[1::2], strict=True):
            pieces.append(strings[i][low : high - 1 + SPAN])
            places.append((i, low))
    found: list[list[np.ndarray]] = [[] for _ in strings]
    if pieces:
        for (i, low), starts in zip(places, _sorted_repeats(pieces), strict=True):
            found[i].append(starts + low)
    return [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]


def _sorted_repeats(strings: list[bytes]) -> list[np.ndarray]:
    """``repeated_windows`` by the suffix array of all strings."""
    sizes = [len(s) for s in strings]
    first = np.cumsum([0, *[s + 1 for s in sizes]])
    joined = b"".join(s + b"\0" for s in strings)
    letters = np.frombuffer(joined, np.uint8).astype(np.int64) + 2
    letters[first[1:] - 1] = 1  # between strings
    order = suffix_array(np.r_[letters, 0])
    fits = np.zeros(len(letters) + 1, bool)
    for f, s in zip(first.tolist(), sizes, strict=False):
        fits[f : f + s - SPAN + 1] = True
    order = np.array(order)
    order = order[fits[order]].tolist()
    again = np.zeros(len(letters), bool)
    for a, b in zip(order, order[1:], strict=False):
        if joined[a : a + SPAN] == joined[b : b + SPAN]:
            again[a] = again[b] = True
    return [np.flatnonzero(again[f : f + s]) for f, s in zip(first.tolist(), sizes, strict=False)]


def ranges(starts: np.ndarray) -> list[dict[str, int]]:
    """Byte ranges covered by windows at sorted starts, as ``low`` and ``high``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > SPAN) + 1
    return [{"low": int(p[0]), "high": int(p[-1]) + SPAN} for p in np.split(starts, cut)]


_RANGES = "array<struct<low:long,high:long>>"


def _by_suffix_array(strings: DataFrame) -> DataFrame:
    """``key, digest, found`` for distinct segments (key, digest, body), sorted by key."""

    def run(batches):
        key, group = None, []
        arrow = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

        def close():
            found = [ranges(s) for s in repeated_windows([b for _, b in group])]
            keep = [i for i, f in enumerate(found) if f]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([key] * len(keep), pa.int64()),
                    pa.array([group[i][0] for i in keep], pa.int64()),
                    pa.array([found[i] for i in keep], arrow),
                ],
                ["key", "digest", "found"],
            )

        for batch in batches:
            for k, digest, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != key:
                    if group:
                        yield close()
                    key, group = k, []
                group.append((digest, body))
        if group:
            yield close()

    # Sorting costs time by the byte: tasks of this size are not merged into fewer.
    n_bytes = strings.agg(F.sum(F.length("body")).alias("n")).first().n or 0
    tasks = min(max(n_bytes // TASK_BYTES, 1) + 7, MOST_TASKS)
    dealt = strings.select("key", "digest", "body").repartition(tasks, "key").sortWithinPartitions("key", "digest")
    return dealt.mapInArrow(run, f"key long, digest long, found {_RANGES}")


def _by_window(strings: DataFrame) -> DataFrame:
    """The same for keys with too many bytes for one group: every window has a group of its own."""

    def make():
        def split(key, digest, body):
            hashes = _Hashes(np.frombuffer(body, np.uint8)).all_of(SPAN).view(np.int64).tolist()
            for at, h in enumerate(hashes):
                yield key, digest, at, h

        return split

    each = map_rows(strings.select("key", "digest", "body"), make, "key long, digest long, at int, window long")
    twice = each.groupBy("key", "window").agg(F.count("*").alias("_n")).where("_n > 1").select("key", "window")
    hit = each.join(twice.hint("merge"), ["key", "window"]).select("key", "digest", "at")
    lists = hit.groupBy("key", "digest").agg(F.sort_array(F.collect_set("at")).alias("at"))

    def close():
        def of(key, digest, at):
            yield key, digest, ranges(np.array(at))

        return of

    return map_rows(lists, close, f"key long, digest long, found {_RANGES}")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` as ``_doc`` with ``_text`` and the keys of the row."""
    filled = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), text_column(text).alias("_text"))
    ident = F.col(f"_doc.`{doc_id}`").cast("string")
    return filled.select("_doc", "_text", F.xxhash64(ident, "_text").alias("_k1"), F.xxhash64("_text", ident).alias("_k2"))


def repeats(rows: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``_k1, _k2, ranges``: byte ranges of ``_text`` to remove, for rows with any."""
    single = materialise(_segment_rows(rows), "segments")
    of_key = single.groupBy("key").agg(F.count("*").alias("_n"), F.min("digest").alias("_low"), F.max("digest").alias("_high"))
    # Written, so that both sides of the join are plain exchanges and a hot key can be split.
    shared = materialise(of_key.where("_n > 1").select("key", (F.col("_low") != F.col("_high")).alias("mixed")), "shared-keys")
    active = materialise(single.join(shared.hint("merge"), "key"), "shared-segments")
    discard(single, shared)

    mixed = active.where("mixed")
    kinds = mixed.groupBy("key", "digest").agg(
        F.count("*").alias("copies"), F.min(F.struct("_k1", "_k2", "at", "n")).alias("first")
    )
    kinds = materialise(kinds.select("key", "digest", "copies", "first.*"), "segment-kinds")
    sizes = kinds.groupBy("key").agg(F.sum(F.col("n") + SPAN - 1).alias("_bytes"))
    wide = sizes.where(F.col("_bytes") > group_bytes).select("key", F.lit(True).alias("wide"))
    wanted = kinds.join(wide.hint("merge"), "key", "left").groupBy("_k1", "_k2").agg(
        F.collect_list(F.struct("at", "n", "key", "digest", F.coalesce("wide", F.lit(False)).alias("wide"))).alias("_wanted")
    )

    def make():
        def cut(text, parts):
            data = text.encode()
            for p in parts:
                yield p["key"], p["digest"], p["wide"], data[p["at"] : p["at"] + p["n"] - 1 + SPAN]

        return cut

    # Equal rows have equal keys; one of them is enough, the others give equal strings.
    texts = rows.select("_k1", "_k2", "_text").join(wanted.hint("merge"), ["_k1", "_k2"])
    strings = map_rows(
        texts.select("_text", "_wanted"), make, "key long, digest long, wide boolean, body binary", lambda r: 64 + len(r[3])
    ).dropDuplicates(["key", "digest"])
    strings = materialise(strings, "segment-strings")
    found = _by_suffix_array(strings.where("not wide")).unionByName(_by_window(strings.where("wide")))

    whole = F.array(F.struct(F.lit(0).cast("long").alias("low"), (F.col("n") - 1 + SPAN).cast("long").alias("high")))
    often = kinds.select("key", "digest", (F.col("copies") > 1).alias("often"))
    # Written for the same reason: a hot (key, digest) must not stay in one task.
    verdict = materialise(often.join(found.hint("merge"), ["key", "digest"], "left"), "segment-verdicts")
    discard(strings)
    placed = mixed.join(verdict.hint("merge"), ["key", "digest"]).select(
        "_k1", "_k2", "at", F.when(F.col("often"), whole).otherwise(F.col("found")).alias("found")
    )
    equal = active.where("not mixed").select("_k1", "_k2", "at", whole.alias("found"))
    each = equal.unionByName(placed.where(F.size("found") > 0)).distinct()
    shifted = F.transform("found", lambda r: F.struct((r["low"] + F.col("at")).alias("low"), (r["high"] + F.col("at")).alias("high")))
    return each.groupBy("_k1", "_k2").agg(F.flatten(F.collect_list(shifted)).alias("ranges"))


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal disjoint ranges, in order; ranges that touch are joined."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in found or []):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for low, high in spans:
        parts.append(data[at:low])
        at = high
    return b"".join([*parts, data[at:]])


def located(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``_doc`` (the row), ``_text`` and ``ranges`` (null if nothing is to be removed)."""
    rows = keyed(docs, doc_id, text)
    found = repeats(rows, group_bytes)
    return rows.join(found.hint("merge"), ["_k1", "_k2"], "left").select("_doc", "_text", "ranges")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated strings cut out of the text.

    Null texts stay null. Where a cut leaves part of a character, that part goes too.
    """
    found = located(docs, doc_id, text)

    @F.arrow_udf("string")
    def shortened(texts: pa.Array, spans: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([kept(t.encode(), merged(s)).decode(errors="ignore") for t, s in pairs], pa.string())

    new = F.when(F.col("ranges").isNull(), F.col(f"_doc.`{text}`")).otherwise(shortened("_text", "ranges"))
    return found.select(*[new.alias(c) if c == text else F.col(f"_doc.`{c}`") for c in docs.columns])


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = located(read(spark, sf_dir).select("doc_id", "text"))

    def make():
        def digest(doc, text, found):
            data = text.encode()
            spans = merged(found)
            rest = kept(data, spans)
            yield doc, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()

        return digest

    id_type = found.schema["_doc"].dataType["doc_id"].dataType.simpleString()
    return map_rows(
        found.select(F.col("_doc.doc_id").alias("doc_id"), "_text", "ranges"),
        make,
        f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    )


ORACLE = """
with b as (
    select row_number() over () as row, doc_id, encode(coalesce(text, '')) as t, octet_length(encode(coalesce(text, '')))::bigint as n
    from documents),
windows as (select row, i, t[i + 1 : i + 200] as s from (select row, t, unnest(range(0, n - 199)) as i from b)),
twice as (select s from windows group by s having count(*) > 1),
starts as (select row, i from windows semi join twice using (s)),
marked as (select row, i, case when i <= lag(i) over (partition by row order by i) + 200 then 0 else 1 end as fresh from starts),
numbered as (select row, i, sum(fresh) over (partition by row order by i) as run from marked),
runs as (select row, run, min(i) as low, max(i) + 200 as high from numbered group by row, run),
edges as (
    select row, high as low, lead(low, 1) over (partition by row order by low) as high from runs
    union all select row, 0, min(low) from runs group by row),
pieces as (select row, e.low, coalesce(e.high, n) as high, t from edges e join b using (row)),
rests as (select row, string_agg(hex(t[low + 1 : high]), '' order by low) as rest from pieces group by row),
sums as (select row, sum(high - low)::bigint as n_removed, count(*)::bigint as n_spans from runs group by row)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(case when rest is null then t else unhex(rest) end) as kept_sha256
from b left join sums using (row) left join rests using (row)
"""
