import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crashgrid.llm import queries, suffix_dedup
from crashgrid.llm.suffix_array import suffix_array
from crashgrid.llm.texts import read

SPAN = suffix_dedup.SPAN


def brute(texts):
    """Per text: maximal removed runs and the bytes left."""
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + SPAN] for d in datas for i in range(len(d) - SPAN + 1))
    out = []
    for d in datas:
        cover = bytearray(len(d))
        for i in range(len(d) - SPAN + 1):
            if seen[d[i : i + SPAN]] > 1:
                cover[i : i + SPAN] = b"\1" * SPAN
        runs = len(bytes(cover).replace(b"\0", b" ").split())
        out.append((len(d), sum(cover), runs, hashlib.sha256(bytes(b for b, c in zip(d, cover) if not c)).hexdigest()))
    return out


def results(docs, **options):
    rows = suffix_dedup.located(docs, **options).collect()
    out = []
    for r in rows:
        spans = suffix_dedup.merged(r.ranges)
        rest = suffix_dedup.kept(r._text.encode(), spans)
        n = len(r._text.encode())
        out.append((r._doc.doc_id, n, n - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
    return Counter(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array(letters):
    text = [*letters, 0]
    assert suffix_array(np.array(text)) == sorted(range(len(text)), key=lambda i: text[i:])


def test_query_matches_brute_force(spark, small):
    docs = read(spark, small).select("doc_id", "text").collect()
    rows = queries.QUERIES["op8_suffix_dedup"](spark, small).collect()
    want = Counter((d.doc_id, *b) for d, b in zip(docs, brute([d.text for d in docs])))
    assert Counter(map(tuple, rows)) == want
    assert any(r.n_removed for r in rows)


def odd_texts():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij é", k=9)) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choices(words, k=n))

    passage, long = prose(40), prose(3000)
    return [
        None,
        "",
        "short",
        "a" * 199,
        "b" * 200,
        "c" * 201,
        "ab" * 400,
        passage,
        passage,
        prose(30) + passage + prose(30),
        prose(30) + passage + prose(10) + passage[:250],
        passage[50:300],
        "é" * 150 + passage.encode()[:199].decode(errors="ignore"),
        long,
        long[:4000] + "X" + long[4001:9000],
        long[1:],
    ]


@pytest.mark.parametrize("group_bytes", [1 << 20, 600])
def test_odd_texts(make_docs, group_bytes):
    texts = odd_texts()
    docs = make_docs(texts).withColumnRenamed("source", "key").withColumnRenamed("lang", "ranges")
    want = Counter((i, *b) for i, b in enumerate(brute(texts)))
    assert results(docs, group_bytes=group_bytes) == want


def test_equal_rows_and_missing_ids(make_docs):
    text = "".join(random.Random(1).choices("abcdefgh ", k=300))
    pairs = [(1, text), (1, text), (None, text), (None, None), (2, "x" + text[:200])]
    want = Counter((i, *b) for (i, _), b in zip(pairs, brute([t for _, t in pairs])))
    assert results(make_docs(pairs)) == want


def test_empty_table(make_docs):
    assert results(make_docs([])) == Counter()


def test_texts_without_repeats(make_docs):
    texts = odd_texts()
    docs = make_docs(texts)
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for i, (text, found) in enumerate(zip(texts, brute(texts))):
        if found[1] == 0:
            assert rows[i].text == text
        else:
            assert len(rows[i].text.encode()) <= found[0] - found[1]
    assert rows[0].text is None


def test_long_text_crosses_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    data = np.frombuffer("".join(random.Random(2).choices("abc", k=2000)).encode(), np.uint8)
    total = 0
    for first in range(0, len(data) - SPAN + 1, 300):
        start, count, _, _ = suffix_dedup.segments(data[first : first + 300 + SPAN - 1])
        total += count.sum()
    assert total == len(data) - SPAN + 1
