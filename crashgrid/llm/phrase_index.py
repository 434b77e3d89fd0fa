"""Benchmark decontamination with a positional inverted index.

All tokens of the training texts are stored once as posting lists: per block of texts and
per term the places of the term, counted through the block. A look-up keeps the lists of
terms that occur in test items, by a join on the term, and brings those of a block together
with the test items by a cogroup. There the windows of the items start from their rarest
term: the places of that term, shifted by its offset in the window, are the candidate
starts. The other terms, from rare to frequent, keep the candidates whose shifted place
stands in their list. What is left are exact phrases; with a slack, each word may stand
that many places off.

Texts, terms and windows are spread over blocks of bounded size, so a term, a passage or a
group of copies that a third of the texts hold is shared by all tasks. Items are dealt into
bundles of about 65,536 words, long ones in overlapping segments. Candidates of a block are
checked in portions of bounded size, and equal windows once.

Every row of the texts is a document of its own, also rows with equal or null ids. Null and
empty texts have no words and no hits. An item row without words matches nothing; an item of
fewer words than a window is one window. Items with equal ids count as one, and items without
an id mark words but are not listed. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrid.llm.texts import read, text_column
from crashgrid.llm.tokens import blocks, lists, term_stream
from crashgrid.sources.storage import materialise

WINDOW = 10
BLOCK_TEXTS, BLOCK_BYTES = 4096, 8 << 20
#: Places between the last word of a text and the first of the next one.
GAP = 64
SEGMENT_WORDS, BUNDLE_WORDS = 4096, 1 << 16
#: Candidate starts checked at once.
PORTION = 1 << 21

_MATCH = "block long, text int, item long, start long, stop long"


def index_positions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Posting lists ``block, term, n, places``, and a head row per block.

    ``places`` holds the first place and then the distances (32 bit). The head has no ``term``;
    its ``ids`` and ``sizes`` list the texts and their numbers of words. Blocks are numbered as
    they are read: write the result before reading it twice.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_column(f"`{text}`").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        names = ["block", "term", "n", "places", "ids", "sizes"]
        for part in blocks(batches, "text", BLOCK_TEXTS, BLOCK_BYTES):
            terms, sizes = term_stream(part.column("text"))
            all_texts = pa.array([0, part.num_rows], pa.int32())
            ids = pa.ListArray.from_arrays(all_texts, part.column("doc_id"))
            counts = pa.ListArray.from_arrays(all_texts, pa.array(sizes, pa.int64()))
            block, none = pa.array([number]), pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([block, none, pa.array([len(terms)]), pa.nulls(1, pa.binary()), ids, counts], names)
            if len(terms):
                places = np.arange(len(terms)) + np.repeat(GAP * np.arange(len(sizes)), sizes)
                order = np.argsort(terms, kind="stable")
                terms, places = terms[order], places[order]
                first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
                steps = np.diff(places, prepend=0)
                steps[first] = places[first]
                ends = np.r_[first[1:], len(terms)]
                columns = [
                    pa.array(np.full(len(first), number)),
                    pa.array(terms[first].view(np.int64)),
                    pa.array(ends - first),
                    lists(steps.astype("<i4"), ends),
                    pa.nulls(len(first), ids.type),
                    pa.nulls(len(first), counts.type),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
            number += 1

    return rows.mapInArrow(run, f"block long, term long, n long, places binary, ids array<{id_type}>, sizes array<long>")


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``item, item_id, width, n, words``: segments of item rows whose windows of ``width`` words make up the item."""
    rows = items.select(F.col(f"`{item_id}`").alias("item_id"), text_column(f"`{text}`").alias("text"))
    id_type = rows.schema["item_id"].dataType.simpleString()

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for part in blocks(batches, "text", BLOCK_TEXTS, BLOCK_BYTES):
            words, sizes = term_stream(part.column("text"))
            at, out = 0, []
            for row, size in enumerate(sizes.tolist()):
                width = min(window, size)
                for first in range(0, size and size - width + 1, SEGMENT_WORDS):
                    last = min(first + SEGMENT_WORDS + width - 1, size)
                    out.append((number + row, row, width, last - first, words[at + first : at + last].astype("<u8").tobytes()))
                at += size
            owner, row, width, n, body = zip(*out, strict=True) if out else [()] * 5
            columns = [pa.array(owner, pa.int64()), part.column("item_id").take(pa.array(row, pa.int64())), pa.array(width, pa.int32())]
            columns += [pa.array(n, pa.int64()), pa.array(body, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "width", "n", "words"])
            number += part.num_rows

    return rows.mapInArrow(run, f"item long, item_id {id_type}, width int, n long, words binary")


def item_vocabulary(segments: DataFrame) -> DataFrame:
    """``bundle, term``: the distinct terms of each bundle of segments."""

    def run(batches):
        for batch in batches:
            for bundle, body in zip(batch.column("bundle").to_pylist(), batch.column("words").to_pylist(), strict=True):
                terms = np.unique(np.frombuffer(body, "<u8")).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), bundle)), pa.array(terms)], ["bundle", "term"])

    return segments.select("bundle", "words").mapInArrow(run, "bundle long, term long").distinct()


def matches(index: DataFrame, segments: DataFrame, slack: int = 0) -> DataFrame:
    """``block, text, item, start, stop``: runs of words of a text covered by windows of an item.

    ``index`` comes from ``index_positions`` and ``segments`` from ``item_words``, both written.
    A window matches at a start s when each of its words, with offset o, occurs in the text at
    most ``slack`` places from s + o; it covers the places s to s + width that the text has.
    Runs of one item in one text are joined where they touch.
    """
    if slack < 0 or WINDOW + 2 * slack >= GAP:
        raise ValueError(f"the slack must lie between 0 and {(GAP - WINDOW - 1) // 2}")
    n_words = segments.agg(F.sum("n").alias("n")).first().n or 0
    n_bundles = -(-n_words // BUNDLE_WORDS) or 1
    dealt = segments.withColumn("bundle", F.pmod(F.xxhash64("item", "words"), F.lit(n_bundles)))
    heads = index.where("term is null")
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bundles - 1).cast("long")))
    asked = heads.select("block", numbers.alias("bundle")).join(dealt, "bundle").select("block", "bundle", "item", "width", "words")
    none = F.lit(None)
    found = index.where("term is not null").join(item_vocabulary(dealt), "term").select("block", "bundle", "term", "places", none.alias("sizes"))
    sizes = heads.select("block", numbers.alias("bundle"), none.alias("term"), none.alias("places"), "sizes")
    postings = found.unionByName(sizes).withColumnsRenamed({"block": "of_block", "bundle": "of_bundle"})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _block_matches(left, right, slack)

    return asked.groupBy("block", "bundle").cogroup(postings.groupBy("of_block", "of_bundle")).applyInArrow(run, _MATCH)


class _Lists:
    """The posting lists of one block: one sorted array of (rank of term, place)."""

    def __init__(self, terms: np.ndarray, places: list[bytes]):
        order = np.argsort(terms)
        self.terms = terms[order]
        steps = [np.frombuffer(places[i], "<i4") for i in order]
        self.sizes = np.array([len(s) for s in steps], np.int64)
        self.first = np.r_[0, np.cumsum(self.sizes)]
        sums = np.cumsum(np.concatenate(steps, dtype=np.int64)) if steps else np.zeros(0, np.int64)
        before = np.r_[0, sums][self.first[:-1]]
        self.places = sums - np.repeat(before, self.sizes)
        self.keys = (np.repeat(np.arange(len(steps)), self.sizes) << 32) + self.places

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 where the block does not have it."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def near(self, rank: np.ndarray, place: np.ndarray, slack: int) -> np.ndarray:
        """Whether the list of ``rank`` has a place at most ``slack`` from ``place``."""
        at = np.searchsorted(self.keys, (rank << 32) + place - slack)
        at = np.minimum(at, len(self.keys) - 1)
        off = self.keys[at] - ((rank << 32) + place)
        return (off >= -slack) & (off <= slack)

    def starts(self, windows: np.ndarray, slack: int):
        """Portions of (row of ``windows``, start) of all matches; rows are ranks of terms."""
        sizes = self.sizes[windows]
        order = np.argsort(sizes, axis=1, kind="stable")
        rarest = order[:, 0]
        rank = windows[np.arange(len(windows)), rarest]
        many = self.sizes[rank] * (2 * slack + 1)
        ends = np.cumsum(many)
        at = 0
        while at < len(windows):
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, "right")))
            row = np.repeat(np.arange(at, until), self.sizes[rank[at:until]])
            nth = np.arange(len(row)) - np.repeat(np.cumsum(self.sizes[rank[at:until]]) - self.sizes[rank[at:until]], self.sizes[rank[at:until]])
            start = self.places[self.first[rank[row]] + nth] - rarest[row]
            if slack:
                row = np.repeat(row, 2 * slack + 1)
                start = (start[:, None] + np.arange(-slack, slack + 1)).ravel()
            for column in order.T[1:]:
                offset = column[row]
                kept = self.near(windows[row, offset], start + offset, slack)
                row, start = row[kept], start[kept]
            yield row, start
            at = until


def _block_matches(left: pa.Table, right: pa.Table, slack: int) -> pa.Table:
    out: list[tuple[np.ndarray, ...]] = []
    if left.num_rows and right.num_rows:
        left, right = left.combine_chunks(), right.combine_chunks()
        is_head = right.column("term").is_null().to_numpy()
        sizes = np.array(right.column("sizes")[int(np.flatnonzero(is_head)[0])].as_py(), np.int64)
        lists_of = right.filter(pa.array(~is_head))
        found = _Lists(lists_of.column("term").to_numpy().astype(np.int64).view(np.uint64), lists_of.column("places").to_pylist())
        begin = np.r_[0, np.cumsum(sizes)[:-1]] + GAP * np.arange(len(sizes))
        widths = left.column("width").to_numpy()
        items = left.column("item").to_numpy()
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            ranks = [found.ranks(np.frombuffer(left.column("words")[int(r)].as_py(), "<u8")) for r in rows]
            windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(r, width) for r in ranks])
            owner = np.repeat(items[rows], [len(r) - width + 1 for r in ranks])
            there = (windows >= 0).all(axis=1)
            if not there.any():
                continue
            windows, which = np.unique(windows[there], axis=0, return_inverse=True)
            pairs = np.unique(np.column_stack([which.ravel(), owner[there]]), axis=0)
            per_window = np.bincount(pairs[:, 0], minlength=len(windows))
            first_pair = np.cumsum(per_window) - per_window
            for row, start in found.starts(windows, slack):
                many = per_window[row]
                nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                start = np.repeat(start, many)
                out.append(_merged(pairs[np.repeat(first_pair[row], many) + nth, 1], start, start + width))
        item, start, stop = _merged(*(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)))
        # All words of a match lie in its text, so its span begins at most the slack before it.
        text = np.searchsorted(begin - slack, start, "right") - 1
        start = np.clip(start - begin[text], 0, sizes[text])
        stop = np.clip(stop - begin[text], 0, sizes[text])
        block = np.full(len(item), left.column("block")[0].as_py())
    else:
        block = text = item = start = stop = np.zeros(0, np.int64)
    return pa.table({"block": block, "text": text.astype(np.int32), "item": item, "start": start, "stop": stop})


def _merged(item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans joined where spans of one item overlap or touch."""
    order = np.lexsort((start, item))
    item, start, stop = item[order], start[order], stop[order]
    if not len(item):
        return item, start, stop
    new_item = np.r_[True, item[1:] != item[:-1]]
    # All stops of an item so far, made comparable by a large step per item.
    step = np.cumsum(new_item) * (int(stop.max() - min(start.min(), 0)) + GAP)
    reach = np.maximum.accumulate(stop + step) - step
    new = np.r_[True, (start[1:] > reach[:-1]) | new_item[1:]]
    first = np.flatnonzero(new)
    return item[first], start[first], reach[np.r_[first[1:], len(item)] - 1]


def documents_of(index: DataFrame) -> DataFrame:
    """``block, text, doc_id, n_words``: a row per text."""
    texts = index.where("term is null").select("block", F.posexplode(F.arrays_zip("ids", "sizes")).alias("text", "of"))
    return texts.select("block", "text", F.col("of.ids").alias("doc_id"), F.col("of.sizes").alias("n_words"))


def digest_columns(index: DataFrame, segments: DataFrame, found: DataFrame) -> DataFrame:
    """Per document the words hit by any item and the ids of the items found."""
    names = segments.select("item", F.col("item_id").cast("string").alias("item_id")).distinct()
    spans = F.array_sort(F.collect_list(F.struct("start", "stop")))

    def widen(done, span):
        return F.struct(
            (done["n"] + F.greatest(span["stop"] - F.greatest(span["start"], done["upto"]), F.lit(0).cast("long"))).alias("n"),
            F.greatest(done["upto"], span["stop"]).alias("upto"),
        )

    zero = F.lit(0).cast("long")
    per_text = (
        found.join(names, "item")
        .groupBy("block", "text")
        .agg(spans.alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
        .select("block", "text", F.aggregate("spans", F.struct(zero.alias("n"), zero.alias("upto")), widen)["n"].alias("n_hit"), "items")
    )
    n_hit, items = F.coalesce("n_hit", zero), F.coalesce("items", F.array().cast("array<string>"))
    return documents_of(index).join(per_text, ["block", "text"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op13_phrase_decontamination(spark, sf_dir: str) -> DataFrame:
    index = materialise(index_positions(read(spark, sf_dir)), "positions")
    segments = materialise(item_words(read(spark, sf_dir, "benchmark")), "items")
    return digest_columns(index, segments, matches(index, segments))


ORACLE = r"""
with docs as (
    select row_number() over () as row, doc_id,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
    from documents),
items as (
    select item_id::varchar as item_id, w, least(len(w), 10) as width from (
        select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark)
    where len(w) > 0),
windows as (
    select distinct item_id, width, array_to_string(w[i : i + width - 1], ' ') as phrase
    from (select item_id, w, width, unnest(range(1, len(w) - width + 2)) as i from items)),
phrases as (
    select row, i, width, array_to_string(w[i : i + width - 1], ' ') as phrase
    from (select row, w, width, unnest(range(1, len(w) - width + 2)) as i
          from docs, (select distinct width from windows) where len(w) >= width)),
found as (select row, i, p.width, item_id from phrases p join windows using (width, phrase)),
hits as (select row, count(distinct place)::bigint as n_hit from (select row, unnest(range(i, i + width)) as place from found) group by row),
lists as (
    select row, count(*)::bigint as n_items, string_agg(item_id, ',' order by item_id) as names
    from (select distinct row, item_id from found where item_id is not null) group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (row) left join lists using (row)
"""
