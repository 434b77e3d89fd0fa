import hashlib

import numpy as np
import pytest

from crashgrid.llm import fingerprint, queries
from crashgrid.llm.texts import read


def jaccard(one, other):
    a, b = set(fingerprint.digests(one).tolist()), set(fingerprint.digests(other).tolist())
    return len(a & b) / len(a | b)


def expected(pairs):
    rows = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or ""))
    out = []
    for i, (ident, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        out.append((ident, len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(text, edited), jaccard(text, after)))
    return sorted(out, key=repr)


def got(rows):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows), key=repr)


def same(one, other):
    assert [x[:3] for x in one] == [x[:3] for x in other]
    for x, y in zip(one, other):
        assert x[3:] == pytest.approx(y[3:])


def test_query_matches_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in read(spark, small).collect()]
    rows = queries.QUERIES["op3_lookup_fingerprints"](spark, small).collect()
    same(got(rows), expected(docs))
    texts = dict(docs)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)
    long = [r for r in rows if r.n_chars > 1000]
    assert sum(r.near_edited for r in long) / len(long) > 0.5 > sum(r.near_next for r in long) / len(long)


@pytest.mark.parametrize(
    "pairs",
    [
        [(5, "only one")],
        [(None, None), (None, ""), (3, "é😀x\ny" * 9), (3, "é😀x\ny" * 9), (9, "a b c d"), (2, "word " * 20_000)],
        [(-4, "abc\n" * 50), (-4, "abd\n" * 50), (70, ""), (10**12, "abcdefg")],
        [],
    ],
)
def test_odd_rows(make_docs, pairs):
    docs = make_docs(pairs).withColumnRenamed("source", "bucket").withColumnRenamed("lang", "last")
    same(got(fingerprint.compared(docs).collect()), expected(pairs) if pairs else [])


def test_many_ranges(make_docs):
    pairs = [(i * 3 % 101, f"text {i} " * (i % 7)) for i in range(150)]
    same(got(fingerprint.compared(make_docs(pairs)).collect()), expected(pairs))


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(3)
    for common, left, right in [(0, 0, 0), (50, 1, 0), (500, 10, 12), (10, 300, 5), (1000, 700, 900)]:
        keys = np.unique(rng.integers(1, 1 << 62, common + left + right, dtype=np.uint64))
        rng.shuffle(keys)
        one, other = keys[: common + left], np.r_[keys[:common], keys[common + left :]]
        only, new = fingerprint.difference(one, other)
        assert set(only.tolist()) == set(keys[common : common + left].tolist())
        assert set(new.tolist()) == set(keys[common + left :].tolist())


def test_stuck_peeling_is_noticed():
    keys = np.arange(1, 500, dtype=np.uint64)
    assert fingerprint.Table(24, keys).peel() is None
