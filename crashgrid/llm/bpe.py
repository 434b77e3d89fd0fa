"""Byte-level BPE over overlapping chunks, and its inverse.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own, in
parallel; a chunk may start inside a pre-token, so its first boundaries may be wrong.
Matching only looks ahead, so two runs that share one boundary agree from there on:
the first boundary that a chunk shares with its predecessor in the overlap is a true
one, and the text is cut there. The pieces are encoded in parallel. Where an overlap
has no shared boundary (a long run of letters), the chunk is cut at its first change
from other characters to white space, which is a boundary in any text; where it has
none either, it stays joined to its predecessor. Decoding concatenates token bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrid.llm import vocab
from crashgrid.llm.texts import map_rows, read, text_column

CHUNK = 16_384
OVERLAP = 512

#: A change from other characters to white space: no pre-token spans it.
EVIDENT = regex.compile(r"\S(?=\s)")


def boundaries(chunk: str, pattern: regex.Pattern, last: bool) -> list[int]:
    """Starts of pre-tokens in a chunk, read from its beginning.

    A pre-token that touches the end of the chunk could go on after it, and white space
    before it could then end elsewhere, so unless the text ends here too, boundaries
    count only up to the start of the last pre-token that other characters follow.
    """
    starts = [m.start() for m in pattern.finditer(chunk)]
    if not last and starts:
        # A start after white space at the very end depends on what follows.
        while starts and not chunk[starts[-1] :].strip():
            starts.pop()
        starts = starts[:-1] if len(starts) > 1 else starts
    return starts


def encode(
    docs: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """One row per text: ``row`` (key of the input row), ``doc_id``, ``pieces``.

    ``pieces`` holds (start, ids) in order; ``ids`` are little-endian unsigned 32-bit
    numbers. Null is read as empty, and an empty text has one piece without ids.
    """
    if not 0 < overlap <= chunk // 2:
        raise ValueError("an overlap must be positive and at most half a chunk")
    pattern = vocab.pattern()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), text_column(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    whole = map_rows(
        rows.where(F.length("text") <= chunk),
        lambda: _whole_encoder(path),
        f"row long, doc_id {id_type}, pieces array<struct<start:long,ids:binary>>",
        lambda made: 64 + len(made[2][0]["ids"]),
    )

    def cutter():
        def cut(row, doc, body):
            n = -(-len(body) // chunk)
            for k in range(n):
                yield row, doc, k, k == n - 1, body[k * chunk : (k + 1) * chunk + overlap]

        return cut

    chunks = map_rows(
        rows.where(F.length("text") > chunk),
        cutter,
        f"row long, doc_id {id_type}, k int, last boolean, body string",
        lambda made: len(made[4]),
    ).repartition("row", "k")

    def reader():
        compiled = regex.compile(pattern)

        def look(row, k, last, body):
            starts = boundaries(body, compiled, last)
            own = [s for s in starts if s < overlap and not (s and body[s - 1].isspace())]
            tail = [s for s in starts if s >= chunk]
            evident = EVIDENT.search(body, 0, chunk)
            yield row, k, own, tail, evident.end() if evident else -1

        return look

    marks = map_rows(
        chunks.select("row", "k", "last", "body"), reader, "row long, k int, own array<int>, tail array<int>, evident int"
    )
    cuts = marks.groupBy("row").applyInArrow(lambda table: _stitch(table, chunk), "row long, k int, cut int, piece int")

    def splitter():
        def split(row, doc, k, body, cut, piece):
            body = body[:chunk]
            at = cut if cut >= 0 else len(body)
            if at and k:
                yield row, doc, piece - (cut >= 0), k, body[:at]
            if cut >= 0:
                yield row, doc, piece, k, body[at:]

        return split

    fragments = map_rows(
        chunks.join(cuts.hint("merge"), ["row", "k"]).select("row", "doc_id", "k", "body", "cut", "piece"),
        splitter,
        f"row long, doc_id {id_type}, piece int, k int, part string",
        lambda made: len(made[4]),
    )

    def encode_piece(table: pa.Table) -> pa.Table:
        enc = vocab.encoding(path)
        parts = sorted(zip(table["k"].to_pylist(), table["part"].to_pylist(), strict=True))
        ids = enc.encode_to_numpy("".join(p for _, p in parts), disallowed_special=()).astype("<u4").tobytes()
        return pa.table(
            {
                "row": table["row"][:1],
                "doc_id": table["doc_id"][:1],
                "piece": table["piece"][:1],
                "ids": pa.array([ids], pa.binary()),
                "n_chars": pa.array([sum(len(p) for _, p in parts)], pa.int64()),
            }
        )

    encoded = fragments.groupBy("row", "piece").applyInArrow(
        encode_piece, f"row long, doc_id {id_type}, piece int, ids binary, n_chars long"
    )

    def join_pieces(table: pa.Table) -> pa.Table:
        order = np.argsort(table["piece"].to_numpy())
        lengths = table["n_chars"].to_numpy()[order]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        ids = table["ids"].take(pa.array(order)).to_pylist()
        pieces = [{"start": int(s), "ids": i} for s, i in zip(starts, ids, strict=True)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("ids", pa.binary())]))
        return pa.table({"row": table["row"][:1], "doc_id": table["doc_id"][:1], "pieces": pa.array([pieces], kind)})

    joined = encoded.groupBy("row").applyInArrow(
        join_pieces, f"row long, doc_id {id_type}, pieces array<struct<start:long,ids:binary>>"
    )
    return whole.unionByName(joined)


def _whole_encoder(path: str):
    enc = vocab.encoding(path)

    def run(row, doc, body):
        ids = enc.encode_to_numpy(body, disallowed_special=()).astype("<u4").tobytes()
        yield row, doc, [{"start": 0, "ids": ids}]

    return run


def _stitch(table: pa.Table, chunk: int) -> pa.Table:
    """Where each chunk of one text is cut and the number of the piece after the cut."""
    rows = sorted(
        zip(*(table[c].to_pylist() for c in ("k", "own", "tail", "evident")), strict=True), key=lambda r: r[0]
    )
    cuts, pieces, piece, before = [], [], 0, None
    for k, own, tail, evident in rows:
        if k == 0:
            cut = 0
        else:
            cut = evident
            if before is not None:  # the predecessor's boundaries are true ones
                known = {b - chunk for b in before}
                cut = next((b for b in own if b in known), evident)
            piece += cut >= 0
        cuts.append(cut)
        pieces.append(piece)
        before = tail if cut >= 0 else None
    return pa.table(
        {
            "row": table["row"],
            "k": pa.array([r[0] for r in rows], pa.int32()),
            "cut": pa.array(cuts, pa.int32()),
            "piece": pa.array(pieces, pa.int32()),
        }
    )


def decode(ids: bytes, table: list[bytes]) -> bytes:
    """The bytes of little-endian unsigned 32-bit ids."""
    return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """Per text: doc_id, n_tokens, SHA-256 of its ids and of the bytes they decode to."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def make():
        table = vocab.token_bytes(path)

        def run(doc, pieces):
            of_ids, of_bytes, n = hashlib.sha256(), hashlib.sha256(), 0
            for p in pieces:
                of_ids.update(p["ids"])
                of_bytes.update(decode(p["ids"], table))
                n += len(p["ids"]) // 4
            yield doc, n, of_ids.hexdigest(), of_bytes.hexdigest()

        return run

    return map_rows(
        encoded.select("doc_id", "pieces"),
        make,
        f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    path = vocab.default_path("byte_bpe_multi_50k.tiktoken")
    return digests(encode(read(spark, sf_dir), path), path)
