import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import check
from crashgrid.llm import hashing, ngram_join, queries, texts
from crashgrid.llm.components import _unfinished, components
from crashgrid.sources import storage


def shingles(text, n):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(pairs, n, percent):
    """Component (least id, by row) of every row."""
    sets = [shingles(t, n) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (ident, _) in enumerate(pairs):
        ids = [pairs[j][0] for j in range(len(pairs)) if find(j) == find(i) and pairs[j][0] is not None]
        out.append((ident, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def test_query_matches_sql(spark, small):
    ok, text = check.compare(spark, check.duck(small), small, "op1_ngram_join")
    assert ok, text


def chains(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    pairs = []
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([1, 3, 5, 8, 14, 20, 40, 90, 200]))
        for _ in range(rng.randint(1, 6)):
            pairs.append((len(pairs), " ".join(base)))
            base = base[:]
            for _ in range(rng.randint(0, 1 + len(base) // 25)):  # each one near the one before
                base[rng.randrange(len(base))] = rng.choice(words)
    rng.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("seed,n,percent", [(1, 4, 85), (2, 5, 80), (3, 1, 85)])
def test_chains_match_brute_force(make_docs, seed, n, percent):
    pairs = chains(seed)
    rows = ngram_join.join_components(make_docs(pairs), words=n, percent=percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, rows), key=repr) == brute(pairs, n, percent)


ODD = [(1, None), (1, ""), (2, " \n "), (3, "A b c"), (4, "a B C"), (None, "a b c"), (5, "a b"), (6, "x " * 5000), (6, "x " * 5000)]


@pytest.mark.parametrize("hot", [200, 0])
def test_odd_rows(make_docs, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "SAMPLE", 1)
    rng = random.Random(9)
    base = [f"v{rng.randrange(500)}" for _ in range(120)]
    near = [(10 + i, " ".join([*base[:i], "odd", *base[i + 1 :]])) for i in range(0, 100, 3)]
    pairs = ODD + near
    docs = make_docs(pairs).withColumnRenamed("source", "_id").withColumnRenamed("lang", "set")
    rows = ngram_join.join_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, rows), key=repr) == brute(pairs, 4, 85)


def test_empty_table(make_docs):
    assert ngram_join.join_components(make_docs([])).count() == 0


@pytest.mark.parametrize("percent,parts,missing", [(85, 2, 1), (80, 2, 1), (85, 3, 1), (85, 4, 2), (60, 2, 1)])
def test_similar_sets_share_a_signature(percent, parts, missing):
    rng = np.random.default_rng(percent + parts)
    for _ in range(400):
        size = int(rng.integers(2, 400))
        one = np.unique(hashing.mixed(rng.integers(0, 1 << 62, size, dtype=np.uint64)))
        drop = int(rng.integers(0, max(1, int(size * (100 - percent) / 100)) + 1))
        other = np.unique(np.r_[one[drop:], rng.integers(0, 1 << 62, int(rng.integers(0, drop + 1)), dtype=np.uint64)])
        common = len(np.intersect1d(one, other))
        if 100 * common < percent * (len(one) + len(other) - common) or np.array_equal(one, other):
            continue
        left, right = (ngram_join.signatures(x, percent, parts, missing) for x in (one, other))
        assert np.intersect1d(left, right).size, (len(one), len(other), common)


def test_words_across_blocks(monkeypatch):
    data = b"abc de\tf " * 50 + b"long" * 30 + b" end"
    want = hashing.words(data)
    monkeypatch.setattr(hashing, "BLOCK", 16)
    assert np.array_equal(hashing.words(data), want)
    assert len(want) == 152


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").unionAll(spark.createDataFrame([(500, 501)], "a long, b long"))
    rows = {r.node: r.root for r in components(edges).collect()}
    assert rows == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_chains_of_all_orders_come_together(spark):
    """So that components, a long series of jobs, are solved once for all of them."""
    placed = spark.range(60).selectExpr("id % 2 as sig", "id as set", "id div 3 as root")
    want = set()
    for turn in range(ngram_join.CHAINS):
        rows = placed.orderBy("sig", F.xxhash64("set", F.lit(turn)), "set").collect()
        want |= {(min(x.set, y.set), max(x.set, y.set)) for x, y in zip(rows, rows[1:]) if x.sig == y.sig and x.root != y.root}
    found = [tuple(r) for r in ngram_join._chained(placed).collect()]
    assert len(found) == len(set(found)) > 58 and set(found) == want


def test_rounds_are_checked_by_one_exchange(spark):
    edges = spark.createDataFrame([(2, 1), (3, 1), (5, 4)], "u long, v long")
    found = _unfinished(edges)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert found.isEmpty()
    assert {r["at"] for r in _unfinished(edges.union(spark.createDataFrame([(4, 1), (3, 2)], "u long, v long"))).collect()} == {2, 3, 4}


def test_texts_reach_python_some_at_a_time(spark, make_docs):
    """A task over 40 MB of texts holds a few of them."""
    docs = make_docs([(i, f"{i} " + "word " * 1_000) for i in range(40)])
    many = docs.selectExpr("explode(sequence(1, 200)) as n", "text").select("text").coalesce(1)

    def make():
        tracemalloc.start()

        def of(text):
            yield (tracemalloc.get_traced_memory()[1],)

        return of

    most = storage.materialise(texts.map_rows(many, make, "peak long"), "peak")
    assert most.count() == 8_000
    assert most.agg(F.max("peak")).first()[0] < 12 << 20


def test_pieces_keep_all_rows_in_order():
    rows = pa.RecordBatch.from_pydict({"n": list(range(50)), "text": ["x" * (3_000_000 if i == 7 else 100_000) for i in range(50)]})
    found = list(texts.pieces(rows))
    assert len(found) > 3 and [n for p in found for n in p.column(0).to_pylist()] == list(range(50))
    assert list(texts.pieces(rows.slice(0, 0))) == []


def seen_tables(monkeypatch):
    """Rows of the tables that the join writes, by name."""
    found = {}
    write = ngram_join.materialise

    def watched(df, name):
        stored = write(df, name)
        found.setdefault(name, []).append(stored.count())
        return stored

    monkeypatch.setattr(ngram_join, "materialise", watched)
    return found


def test_ngrams_are_kept_for_possible_pairs_only(make_docs, monkeypatch):
    """Sets that share signatures by chance, as more and more do in a larger table, are ruled out before."""
    rng = random.Random(4)
    pairs = [(i, " ".join(rng.choices([f"w{j}" for j in range(40)], k=24))) for i in range(200)]
    pairs += [(200 + i, f"{pairs[i][1]} {pairs[i][1]} x") for i in range(10)]
    tables = seen_tables(monkeypatch)
    rows = ngram_join.join_components(make_docs(pairs), words=1, percent=90).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, rows), key=repr) == brute(pairs, 1, 90)
    assert 10 <= max(tables["ngram-sets"]) < 60


def test_pairs_are_compared_in_turns(make_docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "LOAD", 0.2)
    pairs = chains(5)
    tables = seen_tables(monkeypatch)
    rows = ngram_join.join_components(make_docs(pairs), words=3, percent=85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, rows), key=repr) == brute(pairs, 3, 85)
    assert len(tables["ngram-sets"]) > 3
