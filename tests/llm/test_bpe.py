import hashlib
import random
import struct
from collections import Counter

import pytest
import regex
from tokenizers import Tokenizer

from crashgrid.llm import bpe, prefix_counts, pretoken, queries, vocab
from crashgrid.llm.texts import read

MULTI = vocab.default_path("byte_bpe_multi_50k.tiktoken")
PLAIN = vocab.default_path("byte_bpe_50k.json")
LETTERS = [*" \n\t'aAdslrevtmLé1²٣.,!#<|>  ''   \x1c\x85漢😀", "'re", "'ll", "'ve", "<|endoftext|>", "  ", "abc"]
ODD = [
    (None, None),
    (1, ""),
    (1, "a" * 9000),
    (2, "a b\n\n c '" * 3000),
    (3, " " * 5000 + "x" + "\n" * 4000),
    (4, "'re'll've" * 2000),
    (4, "'re'll've" * 2000),
    (None, "word, " * 4000 + "é" * 700 + " z" * 50),
    (5, "<|endoftext|>" * 3),
]


def strings(n, seed, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choices(LETTERS, k=rng.randint(0, longest))) for _ in range(n)]


def expected(pairs):
    enc = vocab.encoding(MULTI)
    out = Counter()
    for ident, text in pairs:
        text = text or ""
        ids = enc.encode_ordinary(text)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        out[ident, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_op7_matches_the_library(spark, small):
    rows = queries.QUERIES["op7_byte_bpe"](spark, small).collect()
    assert Counter(map(tuple, rows)) == expected([(r.doc_id, r.text) for r in read(spark, small).collect()])


@pytest.mark.parametrize("chunk,overlap", [(1000, 64), (200, 16), (16_384, 512)])
def test_chunks_of_odd_texts(make_docs, chunk, overlap):
    pairs = ODD + [(i, s * 40) for i, s in enumerate(strings(30, 2))]
    docs = make_docs(pairs).withColumnRenamed("source", "row").withColumnRenamed("lang", "k")
    rows = bpe.digests(bpe.encode(docs, MULTI, chunk=chunk, overlap=overlap), MULTI).collect()
    assert Counter(map(tuple, rows)) == expected(pairs)


def test_pieces_say_where_they_start(make_docs):
    text = "some words, and more of them. " * 100
    row = bpe.encode(make_docs([text]), MULTI, chunk=300, overlap=40).first()
    table = vocab.token_bytes(MULTI)
    assert len(row.pieces) > 5
    starts = [p.start for p in row.pieces] + [len(text)]
    for p, end in zip(row.pieces, starts[1:]):
        assert bpe.decode(p.ids, table).decode() == text[p.start : end]


def test_no_rows(make_docs):
    assert bpe.encode(make_docs([]), MULTI).count() == 0
    assert prefix_counts.prefix_counts(make_docs([]), PLAIN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(make_docs([]), MULTI, chunk=10, overlap=9)


def test_pretokens_match_the_pattern():
    pattern = regex.compile(vocab.pattern())
    for text in strings(20_000, 1):
        assert pretoken.split(text) == pattern.findall(text)


def test_prefix_tables_match_the_library():
    tok = Tokenizer.from_file(PLAIN)
    tables = prefix_counts.counter(PLAIN)
    for text in strings(1_500, 3) + ["internationalisation of antidisestablishmentarianism 1234567"]:
        prefixes = [text[:i] for i in range(len(text) + 1)]
        want = [len(e.ids) for e in tok.encode_batch(prefixes, add_special_tokens=False)]
        assert tables.table(text).tolist() == want, text


def test_op5_matches_the_library(spark, small):
    tok = Tokenizer.from_file(PLAIN)
    want = set()
    for r in read(spark, small).collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want.add((r.doc_id, len((r.text or "").encode()), n, n > 1024))
    assert set(map(tuple, queries.QUERIES["op5_prefix_counts"](spark, small).collect())) == want


def test_budgets_without_encoding(spark, make_docs):
    from pyspark.sql import functions as F

    tok = Tokenizer.from_file(PLAIN)
    pairs = [(i, t) for i, (_, t) in enumerate(ODD)]
    docs = make_docs(pairs).withColumnRenamed("source", "n_bytes")
    tables = prefix_counts.prefix_counts(docs, PLAIN)
    rows = tables.select(
        "doc_id",
        "n_bytes",
        prefix_counts.tokens_of(F.col("prefix_tokens"), F.lit(50)).alias("of_50"),
        prefix_counts.longest_prefix(F.col("prefix_tokens"), F.lit(20)).alias("fits_20"),
    ).collect()
    texts = {i: t or "" for i, t in pairs}

    def count(text):
        return len(tok.encode(text, add_special_tokens=False).ids)

    for r in rows:
        text = texts[r.doc_id]
        assert r.n_bytes == len(text.encode())
        assert r.of_50 == count(text[:50])
        assert count(text[: r.fits_20]) <= 20
        assert all(count(text[:n]) > 20 for n in range(r.fits_20 + 1, min(len(text), r.fits_20 + 40) + 1))
