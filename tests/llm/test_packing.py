import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from crashgrid.llm import packing, queries, vocab
from crashgrid.llm.texts import read


def whole(docs):
    tok = Tokenizer.from_file(vocab.default_path("byte_bpe_50k.json"))
    return Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in docs)


def check_pieces(rows, docs, sequence=2048):
    """Pieces add up to the documents, sequences have no gaps and lengths that need no padding."""
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        assert r.length > 0
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= sequence and (at == sequence or at & (at - 1) == 0)
    want = Counter()
    for (i, ids), n in docs.items():
        want[i, len(ids)] += n
    got = Counter()
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == Counter({k: n * k[1] for k, n in want.items()})


def test_query_covers_every_id_once(spark, small):
    docs = [(r.doc_id, r.text) for r in read(spark, small).collect()]
    rows = queries.QUERIES["op2_hilbert_packing"](spark, small).collect()
    check_pieces(rows, whole(docs))
    ids = {i: np.array(v, "<u4") for (i, v) in whole(docs)}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())


def test_odd_rows(make_docs):
    docs = make_docs([(1, None), (1, ""), (2, "x " * 9000), (2, "x " * 9000), (None, "<|endoftext|> a"), (None, None)])
    docs = docs.withColumnRenamed("source", "key").withColumnRenamed("n_chars", "ids")
    rows = packing.packed(docs).collect()
    check_pieces(rows, whole([(r.doc_id, r.text) for r in docs.collect()]))


def test_empty_table(make_docs):
    assert packing.packed(make_docs([])).count() == 0


def test_left_over_lengths():
    for n in range(3000):
        assert sum(packing.last_lengths(n)) == n
        assert all(x & (x - 1) == 0 for x in packing.last_lengths(n))


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (3, 3)])
def test_curve_visits_neighbours(dims, bits):
    side = 1 << bits
    points = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.curve_position(points, bits)
    assert sorted(keys) == list(range(side**dims))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_like_documents_lie_together():
    a, b = np.arange(100, 400), np.arange(20000, 20300)
    keys = packing.curve_key([a, a[:-1], b, b[:-1]], 50257)
    assert abs(keys[0] - keys[1]) < abs(keys[0] - keys[2]) and abs(keys[2] - keys[3]) < abs(keys[2] - keys[1])
