import hashlib
import random
import re

import pytest

from crashgrid.llm import phrase_index
from crashgrid.sources.storage import materialise

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def brute_force(docs, items):
    parts = []
    for item_id, text in items:
        w = words_of(text)
        size = min(10, len(w))
        parts.append((item_id, size, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()))
    out = []
    for doc_id, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for item_id, size, windows in parts:
            for i in range(len(w) - size + 1) if size else ():
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    if item_id is not None:
                        found.add(str(item_id))
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), names, bool(hit)))
    return sorted(out, key=repr)


def near_brute_force(docs, items, slack):
    """(doc, item) with a start s such that every word of a window lies within the slack of its place."""
    out = set()
    for doc_id, text in docs:
        w = words_of(text)
        for item_id, item in items:
            v = words_of(item)
            size = min(10, len(v))
            for i in range(len(v) - size + 1) if v else ():
                for s in range(-slack, len(w) + slack):
                    if all(v[i + o] in w[max(s + o - slack, 0) : max(s + o + slack + 1, 0)] for o in range(size)):
                        out.add((doc_id, item_id))
    return out


def tables(docs, items):
    return materialise(phrase_index.index_positions(docs), "p"), materialise(phrase_index.item_words(items), "i")


def digest(docs, items):
    index, segments = tables(docs, items)
    found = phrase_index.digest_columns(index, segments, phrase_index.matches(index, segments))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def made(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, block int"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def corpus(seed):
    rng = random.Random(seed)
    few = [f"v{i}" for i in range(4)]
    many = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(many, k=rng.randint(8, 40)))) for i in range(20)]
    items += [(30, " ".join(rng.choices(few, k=60))), (31, "v1 v2"), (32, "only"), (33, None), (34, "- -"), (None, "v3 v3 v3"), (3, "v0 v0")]
    docs = []
    for i in range(150):
        text = rng.choices(many + few, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            item = words_of(rng.choice(items)[1])
            at = rng.randint(0, len(text))
            first = rng.randint(0, max(len(item) - 8, 0))
            text[at:at] = item[first : first + rng.randint(5, 30)]
        docs.append((i, " ".join(text)))
    docs += [(7, docs[7][1]), (None, items[0][1]), (200, None), (201, ""), (202, "v1 " * 3000 + items[2][1].upper()), (203, "only")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    docs, items = corpus(seed)
    frames = made(spark, docs, items)
    want = brute_force(docs, items)
    assert digest(*frames) == want
    # Many blocks, bundles, segments and portions give the same.
    monkeypatch.setattr(phrase_index, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(phrase_index, "BUNDLE_WORDS", 100)
    monkeypatch.setattr(phrase_index, "SEGMENT_WORDS", 5)
    monkeypatch.setattr(phrase_index, "PORTION", 3)
    assert digest(*frames) == want


def test_phrases_do_not_cross_texts(spark):
    docs = [(1, "a b c d e"), (2, "f g h i j"), (3, "")]
    assert [r[2] for r in digest(*made(spark, docs, [(1, "a b c d e f g h i j")]))] == [0, 0, 0]


def test_runs_are_joined_per_item(spark):
    text = " ".join(f"t{i}" for i in range(30))
    index, segments = tables(*made(spark, [(1, f"x {text} y {text}")], [(5, text)]))
    rows = phrase_index.matches(index, segments).orderBy("start").collect()
    assert [(r.start, r.stop) for r in rows] == [(1, 31), (32, 62)]


@pytest.mark.parametrize("slack", [1, 3])
def test_proximity_equals_brute_force(spark, monkeypatch, slack):
    monkeypatch.setattr(phrase_index, "BLOCK_TEXTS", 11)
    rng = random.Random(slack)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(2, 14)))) for i in range(8)]
    docs = []
    for i in range(60):
        text = words_of(rng.choice(items)[1])
        for _ in range(rng.randint(0, 4)):  # words swapped with neighbours, put in or left out
            at = rng.randrange(len(text) - 1) if len(text) > 2 else 0
            kind = rng.randrange(3)
            if kind == 0 and len(text) > at + 1:
                text[at], text[at + 1] = text[at + 1], text[at]
            elif kind == 1:
                text.insert(at, "filler")
            elif len(text) > 1:
                text.pop(at)
        docs.append((i, " ".join(text)))
    index, segments = tables(*made(spark, docs, items))
    found = phrase_index.matches(index, segments, slack)
    texts, names = phrase_index.documents_of(index), segments.select("item", "item_id").distinct()
    got = found.join(texts, ["block", "text"]).join(names, "item").collect()
    assert {(r.doc_id, r.item_id) for r in got} == near_brute_force(docs, items, slack)
    assert all(0 <= r.start < r.stop <= r.n_words for r in got)
    exact = {(r[0], r[1]) for r in near_brute_force(docs, items, 0)}
    assert exact < {(r.doc_id, r.item_id) for r in got}


def test_slack_is_checked(spark):
    index, segments = tables(*made(spark, [(1, "a")], [(1, "a")]))
    with pytest.raises(ValueError):
        phrase_index.matches(index, segments, 27)
    with pytest.raises(ValueError):
        phrase_index.matches(index, segments, -1)


def test_empty_tables(spark):
    docs, items = made(spark, [], [])
    some_docs, some_items = made(spark, [(1, "a b")], [(1, "a")])
    assert digest(docs, some_items) == []
    assert [r[:4] for r in digest(some_docs, items)] == [(1, 2, 0, 0)]
