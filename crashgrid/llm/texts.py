"""Small helpers for operators that read whole texts in Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Result rows are handed back in batches of about this many bytes.
BATCH_BYTES = 4 << 20
#: Rows are turned into Python values in pieces of about this many bytes.
PIECE_BYTES = 1 << 20


def text_column(text: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def give_back() -> None:
    """Returns freed memory to the system, so that a worker that waits for its next task stays small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, some at a time."""
    step = max(1, batch.num_rows * PIECE_BYTES // max(batch.nbytes, 1))
    for first in range(0, batch.num_rows, step):
        yield batch.slice(first, step)


def map_rows(
    df: DataFrame, make: Callable[[], Callable[..., Iterator[tuple]]], schema: str, weigh: Callable[[tuple], int] = lambda row: 256
) -> DataFrame:
    """``make()`` runs once per task and gives a function that turns a row into rows.

    Rows go in as positional arguments. ``weigh`` estimates the bytes of a result
    row, so that a batch of large results stays small.
    """
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        row_fn = make()
        out, size = [], 0
        for piece in (p for batch in batches for p in pieces(batch)):
            for row in zip(*(piece.column(i).to_pylist() for i in range(piece.num_columns)), strict=True):
                for made in row_fn(*row):
                    out.append(made)
                    size += weigh(made)
                    if size >= BATCH_BYTES:
                        yield _to_batch(out, arrow)
                        out, size = [], 0
        if out:
            yield _to_batch(out, arrow)
        give_back()

    return df.mapInArrow(run, target)


def _to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read(spark, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
