"""Ranked lexical search by pipelined term partitioning.

The texts are read once into an inverted index: per block of at most 4,096 texts and per
term one posting list. Terms of the search items are dealt to owner stages by weight,
rare terms first. Items are dealt into bundles; for every bundle and block a sparse set of
document accumulators travels through the stages. Each stage is a cogroup of the
accumulators with the posting lists of its terms, and adds whole-number contributions. The
last stage hands on the best documents of every block and item, of which the best of all
blocks are taken.

Accumulators that cannot come among the best any more are dropped between stages: a
document stays while its sum and the most that later stages can add reach the k-th best
sum of its block. A document dropped so may come back with a part of its score, which is
then below the k-th best, so results are those of a full evaluation.

A block bounds what a task holds (block x bundle numbers), and a term that a third of all
texts hold is spread over all blocks. Nothing is broadcast on purpose.

Every row of the texts is a document of its own, also rows with equal ids or texts. Null
texts have no terms; null ids count, and come last among equal scores. Items that are null
or have no terms give no rows. Two item rows with one id are two items. Terms are compared
by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashgrid.llm.texts import read, text_column
from crashgrid.llm.tokens import blocks, lists, term_stream
from crashgrid.sources.storage import materialise

BLOCK_TEXTS, BLOCK_BYTES = 4096, 8 << 20
BUNDLE_ITEMS = 64
#: Least weight of a term in each owner stage but the last: held by about N/256, N/32, N/8 of N texts.
STAGE_WEIGHTS = (5545, 3466, 2079)
#: No document gains more than this per unit of weight.
MOST_GAIN = 1_000_000
TOP = 10

_DOC = "<u2"


def index_terms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Posting lists: ``block, term, n_texts, n_terms, docs, counts``, and a head row per block.

    ``docs`` are places in the block (unsigned 16 bit) and ``counts`` occurrences there
    (unsigned 32 bit). The head has no ``term``; its ``counts`` are terms per text (64 bit) and
    its ``ids`` the ids of the texts in ascending order, nulls last. Blocks are numbered as
    they are read: write the result before reading it twice.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_column(f"`{text}`").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"block long, term long, n_texts long, n_terms long, docs binary, counts binary, ids array<{id_type}>"

    def run(batches):
        import pyarrow.compute as pc

        number = TaskContext.get().partitionId() << 32
        for part in blocks(batches, "text", BLOCK_TEXTS, BLOCK_BYTES):
            part = part.take(pc.sort_indices(part.column("doc_id"), null_placement="at_end"))
            hashes, sizes = term_stream(part.column("text"))
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id"))
            yield _index_batch(number, [None], [np.count_nonzero(sizes)], [len(hashes)], [None], [sizes.astype("<i8").tobytes()], ids)
            if len(hashes):
                text_no = np.repeat(np.arange(len(sizes), dtype=_DOC), sizes)
                order = np.argsort(hashes, kind="stable")
                hashes, text_no = hashes[order], text_no[order]
                new_term = np.r_[True, hashes[1:] != hashes[:-1]]
                pair = np.flatnonzero(new_term | np.r_[True, text_no[1:] != text_no[:-1]])
                counts = np.diff(np.r_[pair, len(hashes)])
                first = np.flatnonzero(new_term)
                of_pair = np.searchsorted(pair, np.r_[first, len(hashes)])
                yield _index_batch(
                    number,
                    hashes[first].view(np.int64),
                    np.diff(of_pair),
                    np.diff(np.r_[first, len(hashes)]),
                    lists(text_no[pair], of_pair[1:]),
                    lists(counts.astype("<u4"), of_pair[1:]),
                    pa.nulls(len(first), ids.type),
                )
            number += 1

    return rows.mapInArrow(run, schema)


def _index_batch(block, term, n_texts, n_terms, docs, counts, ids) -> pa.RecordBatch:
    def number(values):
        return pa.array(values, pa.int64())

    def raw(values):
        return values if isinstance(values, pa.Array) else pa.array(values, pa.binary())

    columns = [number([block] * len(ids)), number(term), number(n_texts), number(n_terms), raw(docs), raw(counts), ids]
    return pa.RecordBatch.from_arrays(columns, ["block", "term", "n_texts", "n_terms", "docs", "counts", "ids"])


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item, item_id, term, repeats``: the terms of every item row, rows numbered as they are read."""
    rows = items.select(F.col(f"`{item_id}`").alias("item_id"), text_column(f"`{text}`").alias("text"))
    id_type = rows.schema["item_id"].dataType.simpleString()

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for part in blocks(batches, "text", BLOCK_TEXTS, BLOCK_BYTES):
            hashes, sizes = term_stream(part.column("text"))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            at = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]) if len(hashes) else order
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(owner[at] + number),
                    part.column("item_id").take(pa.array(owner[at])),
                    pa.array(hashes[at].view(np.int64)),
                    pa.array(np.diff(np.r_[at, len(hashes)])),
                ],
                ["item", "item_id", "term", "repeats"],
            )
            number += part.num_rows

    return rows.mapInArrow(run, f"item long, item_id {id_type}, term long, repeats long")


def term_weight(n_texts: int, df: Column) -> Column:
    """floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_texts + 2) / (2 * df + 1).cast("double"))).cast("long")


def _owner(weight: Column) -> Column:
    stage = F.lit(len(STAGE_WEIGHTS))
    for i in reversed(range(len(STAGE_WEIGHTS))):
        stage = F.when(weight >= STAGE_WEIGHTS[i], i).otherwise(stage)
    return stage


def search(index: DataFrame, terms: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of each item: ``item, item_id, rank, doc_id, score``.

    ``index`` comes from ``index_terms`` and ``terms`` from ``item_terms``, both written. Scores
    are above 0; of equal scores the lower id comes first.
    """
    heads, postings = index.where("term is null"), index.where("term is not null")
    total = heads.agg(F.sum("n_texts").alias("n"), F.sum("n_terms").alias("size")).first()
    n_texts, size = total.n or 0, total.size or 0
    n_items = terms.agg(F.count_distinct("item").alias("n")).first().n
    n_bundles = -(-n_items // BUNDLE_ITEMS) or 1
    stages = len(STAGE_WEIGHTS) + 1

    frequency = postings.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n_texts").alias("df"))
    weighted = (
        terms.select("item", "term", "repeats")
        .join(frequency, "term")
        .withColumn("weight", term_weight(n_texts, F.col("df")))
        .where("weight > 0")
        .select("item", "term", (F.col("repeats") * F.col("weight")).alias("weight"), _owner(F.col("weight")).alias("stage"))
        .withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(n_bundles)))
    )
    weighted = materialise(weighted, "weights")
    later = [F.sum(F.when(F.col("stage") >= s, F.col("weight") * MOST_GAIN).otherwise(0)).alias(f"b{s}") for s in range(stages)]
    bundles = (
        weighted.groupBy("bundle", "item")
        .agg(*later)
        .groupBy("bundle")
        .agg(F.sort_array(F.collect_list(F.struct("item", F.array(*[f"b{s}" for s in range(stages)]).alias("most")))).alias("members"))
        .select("bundle", F.col("members.item").alias("items"), F.flatten("members.most").alias("most"))
    )
    id_type = index.schema["ids"].dataType.simpleString()
    carried = f"bundle long, block long, item long, docs binary, sums binary, ids {id_type}, items array<long>, most array<long>"
    state = (
        heads.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bundles - 1).cast("long"))).alias("bundle"), "block", "counts", "ids")
        .join(bundles, "bundle")
        .select(
            "bundle", "block", F.lit(None).cast("long").alias("item"), F.lit(None).cast("binary").alias("docs"),
            F.col("counts").alias("sums"), "ids", "items", "most",
        )
    )
    for stage in range(stages):
        uses = (
            weighted.where(F.col("stage") == stage)
            .groupBy("bundle", "term")
            .agg(F.collect_list("item").alias("users"), F.collect_list("weight").alias("weights"))
        )
        # Both sides of the cogroup come from the index; new names tell their columns apart.
        owned = postings.join(uses, "term").select(
            F.col("bundle").alias("of_bundle"), F.col("block").alias("of_block"), "docs", "counts", "users", "weights"
        )
        last = stage == stages - 1
        element = index.schema["ids"].dataType.elementType.simpleString()
        state = (
            state.groupBy("bundle", "block")
            .cogroup(owned.groupBy("of_bundle", "of_block"))
            .applyInArrow(_stage_fn(stage, stages, n_texts, size, top, last), f"item long, doc_id {element}, score long" if last else carried)
        )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = state.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(terms.select("item", "item_id").distinct(), "item").select("item", "item_id", "rank", "doc_id", "score")


def _stage_fn(stage: int, stages: int, n_texts: int, size: int, top: int, last: bool):
    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        item = left.column("item").to_numpy()  # null becomes NaN
        head_at = int(np.flatnonzero(left.column("item").is_null().to_numpy())[0])
        head = left.slice(head_at, 1).to_pydict() if not last else None
        lengths = np.frombuffer(left.column("sums")[head_at].as_py(), "<i8")
        items = np.array(left.column("items")[head_at].as_py(), np.int64)
        most = np.array(left.column("most")[head_at].as_py(), np.int64).reshape(len(items), stages)
        norm = 25 + (75 * lengths * n_texts) // max(size, 1)
        sums = np.zeros((len(items), len(lengths)), np.int64)
        for row in range(left.num_rows):
            if row != head_at:
                docs = np.frombuffer(left.column("docs")[row].as_py(), _DOC)
                sums[np.searchsorted(items, int(item[row])), docs] = np.frombuffer(left.column("sums")[row].as_py(), "<i8")
        names = ("docs", "counts", "users", "weights")
        for docs, counts, users, weights in zip(*(right.column(c).to_pylist() for c in names), strict=True):
            docs, tf = np.frombuffer(docs, _DOC), np.frombuffer(counts, "<u4").astype(np.int64)
            gain = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[docs])
            for user, weight in zip(users, weights, strict=True):
                sums[np.searchsorted(items, user), docs] += weight * gain
        if last:
            return _best(sums, items, left.column("ids")[head_at].values, top)
        rest = most[:, stage + 1]
        made = {"item": [None], "docs": [None], "sums": [head["sums"][0]]}
        for i, row in enumerate(sums):
            least = np.partition(row, -top)[-top] if len(row) >= top else 0
            docs = np.flatnonzero((row > 0) & (row + rest[i] >= least))
            if len(docs):
                made["item"].append(int(items[i]))
                made["docs"].append(docs.astype(_DOC).tobytes())
                made["sums"].append(row[docs].astype("<i8").tobytes())
        n = len(made["item"])
        made |= {c: [head[c][0]] * n for c in ("bundle", "block")}
        made |= {c: [head[c][0]] + [None] * (n - 1) for c in ("ids", "items", "most")}
        return pa.table({f.name: pa.array(made[f.name], f.type) for f in left.schema})

    return add


def _best(sums: np.ndarray, items: np.ndarray, ids: pa.Array, top: int) -> pa.Table:
    owner, place = [], []
    for i, row in enumerate(sums):
        least = max(int(np.partition(row, -top)[-top]), 1) if len(row) >= top else 1
        docs = np.flatnonzero(row >= least)
        docs = docs[np.lexsort((docs, -row[docs]))][:top]
        owner.append(np.full(len(docs), i))
        place.append(docs)
    owner, place = np.concatenate(owner), np.concatenate(place)
    return pa.table({"item": items[owner], "doc_id": ids.take(pa.array(place)), "score": sums[owner, place]})


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    index = materialise(index_terms(read(spark, sf_dir)), "terms")
    terms = materialise(item_terms(read(spark, sf_dir, "benchmark")), "items")
    return search(index, terms).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
with words as (
    select row_number() over () as row, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
    from documents),
lengths as (select row, doc_id, len(w)::bigint as n from words where len(w) > 0),
totals as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from lengths),
counts as (select row, t, count(*)::bigint as tf from (select row, unnest(w) as t from words) group by row, t),
queries as (
    select item, item_id, t, count(*)::bigint as q from (
        select row_number() over () as item, item_id,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
        from benchmark) group by item, item_id, t),
weights as (
    select t, floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)::double))::bigint as w
    from (select t, count(*)::bigint as df from counts group by t), totals),
scores as (
    select item, item_id, row, l.doc_id,
           sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::bigint as score
    from queries join weights using (t) join counts using (t) join lengths l using (row), totals
    group by item, item_id, row, l.doc_id)
select item_id, rank::integer as rank, doc_id, score from (
    select *, row_number() over (partition by item order by score desc, doc_id nulls last) as rank from scores where score > 0)
where rank <= 10
"""
