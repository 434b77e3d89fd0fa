import math
import random
import re
from collections import Counter

import pytest

from crashgrid.llm import lexical_search
from crashgrid.sources.storage import materialise

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(UPPER))


def brute_force(docs, items, top=10):
    """All scores by definition."""
    counted = [Counter(terms_of(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counted]
    n, size = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counted for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, _), c, length in zip(docs, counted, sizes):
            score = 0
            for t, q in Counter(terms_of(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    m = 25 + (75 * length * n) // size
                    score += q * w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored, key=lambda s: s[:3])[:top], 1):
            out.append((item_id, rank, doc_id, -score))
    return sorted(out, key=repr)


def searched(spark, docs, items, top=10):
    index = materialise(lexical_search.index_terms(docs), "t")
    terms = materialise(lexical_search.item_terms(items), "i")
    found = lexical_search.search(index, terms, top).select("item_id", "rank", "doc_id", "score")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def made(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_with_many_blocks_and_bundles(spark, monkeypatch, seed):
    monkeypatch.setattr(lexical_search, "BLOCK_TEXTS", 40)
    monkeypatch.setattr(lexical_search, "BUNDLE_ITEMS", 3)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shares = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, shares, k=rng.randint(0, 60)))) for i in range(600)]
    docs += [(600 + i, docs[0][1]) for i in range(30)]  # ties
    docs += [(5, "w1 w2 w300"), (None, "w300 w301"), (None, "w300 w301"), (700, None), (701, ""), (702, "w9 " * 5000)]
    items = [(i, " ".join(rng.choices(words, shares, k=rng.randint(1, 30)))) for i in range(12)]
    items += [(3, "W300 w300-w1"), (50, None), (51, "..."), (None, "w5 w7"), (52, "unknown")]
    assert searched(spark, *made(spark, docs, items)) == brute_force(docs, items)


def test_pruning_drops_accumulators_but_no_result(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=20))) for i in range(500)] + [(1000 + i, f"rare{j} a b") for i in range(20) for j in [i % 3]]
    items = [(1, "rare0 rare1 rare2 a b c d e"), (2, "a b c")]
    frames = made(spark, docs, items)
    assert searched(spark, *frames, top=3) == brute_force(docs, items, 3)


def test_hashed_terms_fold_only_ascii_capitals(spark):
    docs = [(1, "Ärger ÄRGER x"), (2, "ärger"), (3, "a1 A1"), (4, "other")]
    items = [(1, "ÄRGER"), (2, "A1"), (3, "ärger")]
    assert searched(spark, *made(spark, docs, items)) == brute_force(docs, items)


def test_empty_tables(spark):
    docs, items = made(spark, [], [])
    some_docs, some_items = made(spark, [(1, "a b")], [(1, "a")])
    assert searched(spark, docs, some_items) == []
    assert searched(spark, some_docs, items) == []
    assert searched(spark, docs, items) == []


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 1), (2, "c", 2, 2), (3, "d", 2, 2)], "doc_id long, text string, block long, term long")
    items = spark.createDataFrame([(7, "a", 9)], "item_id long, text string, item long")
    assert [r[:3] for r in searched(spark, docs, items)] == [(7, 1, 1)]


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "a a"), ("a", "a a"), ("c", "z"), ("d", "z"), ("e", "y")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert [r[:3] for r in searched(spark, docs, items)] == [("q", 1, "a"), ("q", 2, "b")]
