"""Similarity join on sets of word n-grams with PartEnum signatures.

Two sets of n-grams link when their Jaccard similarity reaches a threshold. Sizes are cut
into bands so that similar sets lie in one band or in neighbouring ones; a band bounds the
number k of elements in which two similar sets differ. The elements are dealt to first-level
parts, each of which has PARTS second-level parts. With more than k / (MISSING + 1)
first-level parts, similar sets differ in at most MISSING elements of one of them, so they
agree on some choice of all but MISSING of its second-level parts. Each choice is hashed to
a signature. Choices without elements carry no information: spare first-level parts make up
for them, as many as a set of the band is expected to leave empty, plus two deviations. A set
with still more empty ones also gives out the least hashes of its elements (a prefix in
hash order) as signatures, of which two similar sets share one.

Sets are told apart by 64-bit hashes, so copies count once. Sets that share a signature are
first compared with the least of them. Where that leaves them in different components, all
their pairs are compared. Sizes and parity maps, kept for every set, rule most pairs out;
n-grams are fetched only for the sets of the others. Comparisons are exact, on the sets of
n-gram hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations
from math import ceil, comb, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashgrid.llm import hashing
from crashgrid.llm.components import components
from crashgrid.llm.texts import give_back, map_rows, pieces, read, text_column
from crashgrid.operators.skew import dealt_anew
from crashgrid.sources.storage import discard, materialise

WORDS, PERCENT = 4, 85
PARTS, MISSING = 2, 1
#: Every SAMPLE-th text (by hash) helps to find signatures that are spread over SPREAD
#: tasks; at most MAX_SPREAD are. This changes the balance only, never the result.
SAMPLE, SPREAD, MAX_SPREAD, HOT = 64, 32, 4_096, 200
#: A task gives out the signatures of equal sets once, as far as it remembers them.
REMEMBERED = 200_000
#: Orders in which neighbours under one signature are compared before all pairs are.
CHAINS = 2
#: Words of 64 bits in a parity map.
MAPS = 16
#: The pairs compared at a time have at most this share of the n-grams of all rows; the others wait.
LOAD = 0.5


#: Spare first-level parts are at most this share of the needed ones.
MOST_SPARE = 0.5


@cache
def spare_parts(needed: int, size: int, parts: int, missing: int) -> int:
    """First-level parts to add so that sets of ``size`` elements rarely leave more than these incomplete."""
    choices, width = comb(parts, missing), parts - missing
    spare = 0
    while spare < MOST_SPARE * needed:
        total = needed + spare
        empty = exp(-size / (total * parts)) ** width
        mean = total * (1 - (1 - empty) ** choices)
        if spare >= mean + 2 * mean**0.5:
            break
        spare += 1
    return spare


@cache
def bands(percent: int, largest: int) -> tuple[tuple[int, int], ...]:
    """(largest size, k) of every band up to a size."""
    out, low = [], 1
    while low <= largest:
        high = low * 100 // percent
        both = high + high * 100 // percent
        out.append((high, both * (100 - percent) // (100 + percent)))
        low = high + 1
    return tuple(out)


def band_of(size: int, percent: int) -> tuple[int, tuple[tuple[int, int], ...]]:
    limit = 1 << max(10, size.bit_length())
    table = bands(percent, limit)
    return int(np.searchsorted([high for high, _ in table], size)), table


def digest(elements: np.ndarray) -> int:
    """Hash of a set."""
    total = hashing.mixed(elements).sum(dtype=np.uint64) + np.uint64(len(elements))
    return int(hashing.mixed(np.array([total]))[0].astype(np.int64))


def signatures(elements: np.ndarray, percent: int = PERCENT, parts: int = PARTS, missing: int = MISSING) -> np.ndarray:
    """Signatures of a set, given as sorted distinct hashes; none for a set without near sets."""
    if not len(elements):
        return elements
    band, table = band_of(len(elements), percent)
    out, few = [], False
    for b in (band, band - 1):
        k = table[b][1] if b >= 0 else 0
        if not k:  # only equal sets are similar
            continue
        first = k // (missing + 1) + 1
        # Every set that uses this band has more elements than the band before allows.
        spare = 0 if k < 6 else spare_parts(first, table[b - 1][0] + 1 if b else 1, parts, missing)
        first += spare
        salted = hashing.mixed(elements ^ np.uint64((b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        part = (salted % np.uint64(first * parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0])
        sums = np.zeros(first * parts, np.uint64)
        sums[part[order][starts]] = np.add.reduceat(hashing.mixed(salted)[order], starts)
        filled = np.bincount(part, minlength=first * parts).reshape(first, parts)
        sums = sums.reshape(first, parts)
        complete = np.ones(first, bool)
        for c, choice in enumerate(combinations(range(parts), parts - missing)):
            columns = list(choice)
            some = filled[:, columns].sum(axis=1) > 0
            complete &= some
            which = np.flatnonzero(some).astype(np.uint64)
            salt = hashing.mixed((which * np.uint64(64) + np.uint64(c)) * np.uint64(4096) + np.uint64(b + 1))
            out.append(hashing.mixed(sums[some][:, columns].sum(axis=1, dtype=np.uint64) ^ salt))
        few |= int((~complete).sum()) > spare
    if few:
        needed = -(-len(elements) * percent // 100)
        out.append(hashing.mixed(elements[: len(elements) - needed + 1] + np.uint64(1)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _elements(text: str, words: int) -> np.ndarray:
    return hashing.shingles(text.encode().lower(), words)


def members(docs: DataFrame, words: int) -> DataFrame:
    """``_k1, _k2, _id, n, set`` and the parity map of every row; a row without words has n = 0."""
    id_type = docs.schema["_id"].dataType.simpleString()

    def make():
        def of(k1, k2, ident, text):
            found = _elements(text, words)
            yield k1, k2, ident, len(found), digest(found), *_parity(found)

        return of

    maps = ", ".join(f"p{i} long" for i in range(MAPS))
    return map_rows(
        docs.select("_k1", "_k2", "_id", "_text"), make, f"_k1 long, _k2 long, _id {id_type}, n long, set long, {maps}", lambda r: 1024
    )


def _signature_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for piece in (p for batch in batches for p in pieces(batch)):
            sigs, sets, rows = [], [], 0
            for text in piece.column(0).to_pylist():
                found = _elements(text, words)
                own = digest(found)
                if own in given:
                    continue
                if len(given) >= REMEMBERED:
                    given.clear()
                given.add(own)
                made = signatures(found, percent)
                sigs.append(made.view(np.int64))
                sets.append(np.full(len(made), own))
                rows += len(made)
                if rows > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(sets))], ["sig", "set"])
                    sigs, sets, rows = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(sets))], ["sig", "set"])
        given.clear()
        give_back()

    return docs.select("_text").mapInArrow(run, "sig long, set long")


def _stars(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``sig, least, set`` for sets that share their ``keys`` with a smaller one.

    Rows of a signature are read as a sorted stream, so a group of any size needs no memory.
    With ``keys`` beyond the signature, the least set of each group also comes, with itself.
    """
    salted = len(keys) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, least, last = None, 0, None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            sig, sets = columns[0], columns[-1]
            if not len(sig):
                continue
            fresh = np.ones(len(sig), bool)
            fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:-1]])
            now = tuple(int(c[0]) for c in columns[:-1])
            fresh[0] = now != key
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(sig)), -1))
            first = np.where(start >= 0, sets[np.maximum(start, 0)], least)
            repeated = np.zeros(len(sig), bool)
            repeated[1:] = ~fresh[1:] & (sets[1:] == sets[:-1])
            repeated[0] = not fresh[0] and int(sets[0]) == last
            out = ~repeated & ((first != sets) | (salted & fresh))
            key, least, last = tuple(int(c[-1]) for c in columns[:-1]), int(first[-1]), int(sets[-1])
            if out.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig[out]), pa.array(first[out]), pa.array(sets[out])], ["sig", "least", "set"]
                )

    dealt = rows.select(*keys, "set").repartition(*keys).sortWithinPartitions(*keys, "set")
    return dealt.mapInArrow(run, "sig long, least long, set long")


def _hot(docs: DataFrame, words: int, percent: int) -> list[int]:
    """Signatures that many different texts of the sample have, at most MAX_SPREAD."""
    sample = docs.where(F.pmod(F.xxhash64("_text", F.lit(3)), F.lit(SAMPLE)) == 0)
    counted = _signature_rows(sample, words, percent).distinct().groupBy("sig").agg(F.count("*").alias("n"))
    rows = counted.where(F.col("n") > HOT).orderBy(F.desc("n"), "sig").limit(MAX_SPREAD).collect()
    return [r.sig for r in rows]


def candidates(docs: DataFrame, words: int, percent: int, scratch: list[DataFrame]) -> DataFrame:
    """``sig, least, set``: sets that share a signature, each with the least of them.

    Tables written for it are added to ``scratch``.
    """
    rows = _signature_rows(docs, words, percent)
    hot = _hot(docs, words, percent)
    if not hot:
        return _stars(rows, ["sig"])
    salt = F.when(F.col("sig").isin(hot), F.pmod(F.col("set"), F.lit(SPREAD))).otherwise(F.lit(0)).cast("long")
    local = materialise(_stars(rows.withColumn("salt", salt), ["sig", "salt"]), "signature-stars")
    scratch.append(local)
    # The least sets of the spread groups meet again; other groups are complete.
    spread = F.col("sig").isin(hot)
    leaders = local.where(spread).select("sig", F.col("least").alias("set")).distinct()
    top = leaders.groupBy("sig").agg(F.min("set").alias("least"))
    met = leaders.join(top, "sig").select("sig", "least", "set")
    inside = local.where(spread).select("sig", "set").distinct().join(top, "sig").select("sig", "least", "set")
    return local.where(~spread & (F.col("least") != F.col("set"))).unionByName(met.unionByName(inside).where("least != set").distinct())


def _parity(elements: np.ndarray) -> list[int]:
    """Bit map with a bit flipped by every element; two maps differ in no more bits than the sets in elements."""
    at = hashing.mixed(elements ^ np.uint64(0x5EED)) & np.uint64(64 * MAPS - 1)
    bits = np.bincount(at.astype(np.int64), minlength=64 * MAPS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def _sets(wanted: DataFrame, docs: DataFrame, of_set: DataFrame, words: int) -> DataFrame:
    """``set, elements`` of the sets in ``wanted``."""
    rows = of_set.join(wanted.hint("merge"), "set")

    def make():
        def of(ident, text):
            yield ident, _elements(text, words).tobytes()

        return of

    texts = docs.select("_k1", "_k2", "_text").join(rows.hint("merge"), ["_k1", "_k2"]).dropDuplicates(["set"])
    return map_rows(texts.select("set", "_text"), make, "set long, elements binary", lambda r: 256 + len(r[1]))


def _possible(percent: int) -> str:
    """Whether sizes and parity maps of ``x`` and ``y`` allow the threshold."""
    differ = " + ".join(f"bit_count(x.p{i} ^ y.p{i})" for i in range(MAPS))
    return (
        f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
        f" and {100 + percent} * ({differ}) <= {100 - percent} * (x.n + y.n)"
    )


def _likely(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """The ``a, b`` of ``pairs`` that sizes and parity maps do not rule out, and ``load``, the sum of their sizes."""
    x, y = about.withColumnRenamed("set", "a").alias("x"), about.withColumnRenamed("set", "b").alias("y")
    return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").where(_possible(percent)).selectExpr("a", "b", "x.n + y.n as load")


def _placed(inside: DataFrame, found: DataFrame) -> DataFrame:
    """``sig, set, root`` with the component of each set so far."""
    roots = found.withColumnRenamed("node", "set")
    return inside.join(roots.hint("merge"), "set", "left").select("sig", "set", F.coalesce("root", "set").alias("root"))


def _chained(placed: DataFrame) -> DataFrame:
    """``a, b``: sets of different components that are neighbours in one of CHAINS orders of their signature's sets."""
    sides = []
    for turn in range(CHAINS):
        order = Window.partitionBy("sig").orderBy(F.xxhash64("set", F.lit(turn)), "set")
        sides += [F.lag("set").over(order).alias(f"_a{turn}"), F.lag("root").over(order).alias(f"_q{turn}")]
    before = F.explode(F.array(*[F.struct(F.col(f"_a{t}").alias("a"), F.col(f"_q{t}").alias("q")) for t in range(CHAINS)]))
    chain = placed.select("set", "root", *sides).select("set", "root", before.alias("_before")).where("_before.q != root")
    return chain.select(F.least("_before.a", "set").alias("a"), F.greatest("_before.a", "set").alias("b")).distinct()


def _linked(pairs: DataFrame, docs: DataFrame, of_set: DataFrame, words: int, percent: int, most: float) -> list[DataFrame]:
    """Written tables of the ``a, b`` of ``pairs`` (distinct sets) that reach the threshold.

    Pairs are compared in turns, so that the n-grams on disk at a time number about ``most``.
    """

    @F.arrow_udf("boolean")
    def near(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            one, other = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            common = np.intersect1d(one, other, assume_unique=True).size
            out.append(100 * common >= percent * (len(one) + len(other) - common))
        return pa.array(out, pa.bool_())

    load = pairs.agg(F.sum("load").alias("n")).first().n or 0
    turns, out = ceil(load / most) if load else 0, []
    for turn in range(turns):
        now = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == turn).select("a", "b")
        wanted = now.select(F.explode(F.array("a", "b")).alias("set")).distinct()
        sets = materialise(_sets(wanted, docs, of_set, words), "ngram-sets")
        first = sets.select(F.col("set").alias("a"), F.col("elements").alias("_x"))
        second = sets.select(F.col("set").alias("b"), F.col("elements").alias("_y"))
        both = now.join(first.hint("merge"), "a").join(second.hint("merge"), "b")
        out.append(materialise(both.where(near("_x", "_y")).select("a", "b"), "ngram-links"))
        discard(sets)
    return out


def _joined(links: list[DataFrame], docs: DataFrame) -> DataFrame:
    """``node, root`` by all ``links``, of which there may be none."""
    none = docs.sparkSession.range(0).selectExpr("id as a", "id as b")
    return components(reduce(DataFrame.unionByName, links, none))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``_id, _text`` and a 128-bit key of the row; equal rows share it."""
    ident = F.col("_id").cast("string")
    rows = docs.select(F.col(doc_id).alias("_id"), text_column(text).alias("_text"))
    return rows.select("*", F.xxhash64(ident, "_text").alias("_k1"), F.xxhash64("_text", ident).alias("_k2"))


def join_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, component, _k1, _k2``.

    ``component`` tells components apart even if ids recur; the last two are the row's key.

    Letters A-Z count as lower case. ``component_id`` is the least id reachable by links.
    A null text, or one without words, has no n-grams and links with nothing.
    """
    rows = keyed(docs, doc_id, text)
    held = materialise(members(rows, words), "ngram-members")
    of_set = held.where("n > 0").groupBy("set").agg(F.min(F.struct("_k1", "_k2")).alias("_first"))
    of_set = of_set.select("set", "_first._k1", "_first._k2")
    about = materialise(held.where("n > 0").select("set", "n", *[f"p{i}" for i in range(MAPS)]).dropDuplicates(["set"]), "ngram-maps")
    most = max(1.0, LOAD * (held.agg(F.sum("n").alias("n")).first().n or 0))
    scratch: list[DataFrame] = []
    stars = materialise(candidates(rows, words, percent, scratch), "ngram-candidates")
    discard(*scratch)

    pairs = stars.select(F.col("least").alias("a"), F.col("set").alias("b")).distinct()
    inside = stars.select("sig", "set").unionByName(stars.select("sig", F.col("least").alias("set"))).distinct()
    inside = materialise(inside, "ngram-groups")
    tried = materialise(_likely(pairs, about, percent), "ngram-pairs")
    discard(stars)
    links = _linked(tried, rows, of_set, words, percent, most)
    found = _joined(links, docs)

    # Neighbours in a few orders of each signature's sets join most of what is left apart;
    # this needs no more pairs than there are sets in each order. Orders go together, so
    # that components are solved once for all of them.
    near = materialise(_likely(_chained(_placed(inside, found)), about, percent).join(tried.hint("merge"), ["a", "b"], "left_anti"), "ngram-pairs")
    extra = _linked(near, rows, of_set, words, percent, most)
    if extra:
        both = materialise(tried.unionByName(near), "ngram-pairs")
        discard(tried)
        tried, links = both, links + extra
        found = _joined(links, docs)
    discard(near)

    # Sets of one signature in different components: every pair counts that sizes and parity
    # maps do not rule out; both are exact bounds.
    placed = _placed(inside, found)
    split = placed.groupBy("sig").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low != _high")
    apart = materialise(placed.join(split.select("sig"), "sig"), "ngram-apart")
    discard(inside)
    known = apart.join(about.hint("merge"), "set")
    condition = F.expr(f"x.sig = y.sig and x.set < y.set and x.root != y.root and {_possible(percent)}")
    more = known.alias("x").join(known.alias("y").hint("merge"), condition)
    more = more.selectExpr("x.set as a", "y.set as b", "x.n + y.n as load")
    more = more.distinct().join(tried.hint("merge"), ["a", "b"], "left_anti")
    more = materialise(more, "ngram-pairs")
    discard(apart, tried, about)
    extra = _linked(more, rows, of_set, words, percent, most)
    if extra:
        links += extra
        found = _joined(links, docs)
    discard(more, *links)

    rooted = held.join(found.withColumnRenamed("node", "set").hint("merge"), "set", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "set"))
    least = rooted.where("n > 0").groupBy("root").agg(F.min("_id").alias("_least"))
    # An exchange on both sides, so that the rows of a large component are split over tasks.
    out = rooted.join(dealt_anew(least, ["root"]).hint("merge"), "root", "left")
    component = F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("root").alias("component"), "_k1", "_k2")


def keep_first(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component in ``found`` (from ``join_components``): the least id.

    Null ids come last; equal ids are told apart by their row key, and of equal rows one
    stays. Documents without words all stay.
    """
    keys = found.where("n_shingles > 0").groupBy("component", "_k1", "_k2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("_id"), F.count("*").alias("copies")
    )
    first = keys.groupBy("component").agg(F.min(F.struct("_id", "_k1", "_k2", "copies")).alias("_first"))
    first = first.select("_first._k1", "_first._k2", (F.col("_first.copies") > 1).alias("_many"))
    empty = found.where("n_shingles = 0").select("_k1", "_k2", F.lit(False).alias("_many")).distinct()
    wanted = materialise(first.unionByName(empty), "kept-documents")
    ident = F.col(doc_id).cast("string")
    body = text_column(text)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.xxhash64(ident, body).alias("_k1"), F.xxhash64(body, ident).alias("_k2")
    )
    kept = rows.join(wanted.hint("merge"), ["_k1", "_k2"])
    if not wanted.where("_many").isEmpty():
        once = kept.where("_many").dropDuplicates(["_k1", "_k2"])
        kept = kept.where("not _many").unionByName(once)
    return kept.select("_doc.*")


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join_components(read(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLE = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id != b.doc_id group by 1, 2),
l as (
  select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b
  where 100 * c >= 85 * (x.n + y.n - c)),
r as (
  select doc_id as a, doc_id as b from documents
  union
  select r.a, l.b from r join l on l.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id
from documents d left join n on n.doc_id = d.doc_id
join (select a, min(b) as component_id from r group by a) m on m.a = d.doc_id
"""
