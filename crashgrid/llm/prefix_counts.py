"""Exact token counts of every prefix of a text.

For one pre-token a dynamic program goes through its prefixes: the encoding of a prefix
ends in the one token whose predecessor, the last token of what lies before it, stands
beside it unmerged. So the count of a prefix is the count at that point plus one. Counts
of pre-tokens add up, and the table then answers how many tokens a truncated text has
and how much text fits a budget without encoding again.
"""

from __future__ import annotations

import json
from array import array
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashgrid.llm import pretoken, vocab
from crashgrid.llm.texts import BATCH_BYTES, read, text_column

LIMIT = 1024
CONTRACTIONS = ("'re", "'ve", "'ll")
#: White space before other characters, at least two of them.
SPACES = regex.compile(r"\s{2,}(?=\S)")


def _letter_bytes() -> dict[str, int]:
    """The byte behind each printable stand-in of the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Counts tokens of all prefixes under the vocabulary of a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level vocabulary without normalising is needed")
        added = [a["content"] for a in spec["added_tokens"]]
        of = _letter_bytes()
        words = {w: i for w, i in spec["model"]["vocab"].items() if w not in added}
        merged = [words["".join(m)] for m in spec["model"]["merges"]]
        if merged != sorted(set(merged)):
            raise ValueError("merges and ids must have one order")
        ranks = {bytes([of[c] for c in w]): i for w, i in words.items()}
        self.vocabulary = set(ranks)
        self.pieces = tiktoken.Encoding("ranks", pat_str=vocab.pattern(), mergeable_ranks=ranks, special_tokens={})
        self.longest = max(map(len, ranks))
        self.pairs: dict[bytes, int] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.cache = pretoken.WordCache(self._deltas, limit=600_000)

    def _first(self, both: bytes) -> int:
        """Length of the first token of two encoded together, or -1 if there are not two."""
        ids = self.pieces._encode_single_piece(both)
        first = len(self.pieces.decode_single_token_bytes(ids[0])) if len(ids) == 2 else -1
        if len(self.pairs) >= 500_000:
            self.pairs.clear()
        self.pairs[both] = first
        return first

    def counts(self, word: str) -> list[int]:
        """Tokens of every prefix of one pre-token, by code points, from the empty one on.

        Only one token can end a prefix, so the order of trying does not matter; most
        often it is the last token with one byte more, or that byte alone.
        """
        vocabulary, pairs, longest = self.vocabulary, self.pairs, self.longest
        data = word.encode()
        n = len(data)
        last, count = [b""] * (n + 1), [0] * (n + 1)
        open_at = 0
        for i in range(1, n + 1):
            for begin in chain((open_at, i - 1), range(max(0, i - longest), i - 1)) if i > 1 else (0,):
                token = data[begin:i]
                if token in vocabulary:
                    if begin:
                        left = last[begin]
                        first = pairs.get(left + token)
                        if (self._first(left + token) if first is None else first) != len(left):
                            continue
                    last[i], count[i], open_at = token, count[begin] + 1, begin
                    break
        if n == len(word):
            return count
        return [0] + [c for i, c in enumerate(count) if i and (i == n or data[i] & 0xC0 != 0x80)]

    def _deltas(self, word: str) -> bytes:
        count = self.counts(word)
        if word in CONTRACTIONS:  # a shorter prefix is a sign and a letter
            count[2] = count[1] + self.counts(word[1])[1]
        return array("h", [b - a for a, b in pairwise(count)]).tobytes()

    def _plain(self, text: str) -> np.ndarray:
        """Counts of all prefixes of a text without special strings."""
        get = self.cache.__getitem__
        deltas = np.frombuffer(b"".join([get(w) for w in pretoken.split(text)]), np.int16)
        out = np.zeros(len(deltas) + 1, np.int32)
        np.cumsum(deltas, out=out[1:])
        for run in SPACES.finditer(text):
            # A prefix that ends here ends in white space, which is then one pre-token.
            a, b = run.span()
            out[b] = out[a] + np.frombuffer(get(text[a:b]), np.int16).sum()
        return out

    def table(self, text: str) -> np.ndarray:
        """Counts of all prefixes, by code points; entry 0 belongs to the empty prefix."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts, base, at = [np.zeros(1, np.int32)], 0, 0
        for found in self.special.finditer(text):
            a, b = found.span()
            open_part = self._plain(text[at : b - 1])  # the special string is not complete yet
            parts.append(open_part[1:] + base)
            base += int(open_part[a - at]) + 1
            parts.append(np.array([base], np.int32))
            at = b
        parts.append(self._plain(text[at:])[1:] + base)
        return np.concatenate(parts)


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: ``doc_id``, ``n_bytes`` and ``prefix_tokens``.

    ``prefix_tokens[n]`` is the number of tokens of the first ``n`` code points. Null is
    read as empty, whose table is [0].
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_column(text).alias("text"))

    def run(batches):
        tables = counter(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            first, size, made = 0, 0, []
            for i, body in enumerate(texts):
                made.append(tables.table(body))
                size += 4 * len(made[-1])
                if size >= BATCH_BYTES or i == len(texts) - 1:
                    offsets = np.zeros(len(made) + 1, np.int32)
                    np.cumsum([len(m) for m in made], out=offsets[1:])
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(made)))
                    n_bytes = pa.array([len(t.encode()) for t in texts[first : i + 1]], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(made)), n_bytes, lists], ["doc_id", "n_bytes", "prefix_tokens"])
                    first, size, made = i + 1, 0, []

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, prefix_tokens array<int>")


def tokens_of(prefix_tokens: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` code points (of the whole text if it is shorter)."""
    return F.get(prefix_tokens, F.least(n_chars, F.size(prefix_tokens) - 1))


def longest_prefix(prefix_tokens: Column, budget: Column) -> Column:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    fits = F.transform(prefix_tokens, lambda c, i: F.when(c <= budget, i))
    return F.array_max(fits)


def op5_prefix_counts(spark, sf_dir: str) -> DataFrame:
    table = prefix_counts(read(spark, sf_dir), vocab.default_path("byte_bpe_50k.json"))
    n_tokens = tokens_of(F.col("prefix_tokens"), F.size("prefix_tokens") - 1)
    counted = table.select("doc_id", "n_bytes", n_tokens.cast("long").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
