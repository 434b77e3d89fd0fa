"""Hilbert tile ids as column expressions.

A tile id is the number of all tiles on lower zooms plus the position of the
tile on the Hilbert curve of its own zoom. Walking the curve from the coarsest
bit to the finest, the orientation is one of four states (swap x/y or not,
invert both or not), so three bits of x and y and a state determine six bits of
the position and the next state. ``_step`` is that rule; ``_tables`` unrolls it.
Each step is one table look-up in its own column, so everything stays in generated
code and nothing is evaluated twice.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashgrid import model

_BITS = 3
_STEPS = 9  # 27 bits cover the deepest zoom, 26
_SIDE = 1 << _BITS
_CELLS = _SIDE * _SIDE


def _step(swap: int, invert: int, x: int, y: int) -> tuple[int, int, int]:
    """(quadrant, next swap, next invert) for one bit of x and of y."""
    if swap:
        x, y = y, x
    x, y = x ^ invert, y ^ invert
    quadrant = (0, 1, 3, 2)[2 * x + y]
    return quadrant, swap ^ (1 - y), invert ^ (x & (1 - y))


@cache
def _tables() -> tuple[list[int], list[int]]:
    """Packed ``value * 4 + state``: x/y bits to curve bits, and the inverse."""
    encode = [0] * (4 * _CELLS)
    decode = [0] * (4 * _CELLS)
    for state in range(4):
        for x in range(_SIDE):
            for y in range(_SIDE):
                swap, invert, d = state & 1, state >> 1, 0
                for bit in reversed(range(_BITS)):
                    q, swap, invert = _step(swap, invert, x >> bit & 1, y >> bit & 1)
                    d = d * 4 + q
                xy, after = x * _SIDE + y, invert * 2 + swap
                encode[state * _CELLS + xy] = d * 4 + after
                decode[state * _CELLS + d] = xy * 4 + after
    return encode, decode


def _walk(table: list[int], z: str, chunks: list[str]) -> list[str]:
    """Aliased look-ups ``_h8`` (coarsest) to ``_h0``, each using the state of the last."""
    # A split literal folds to one array constant.
    values = f"cast(split('{','.join(map(str, table))}', ',') as array<int>)"
    # Unused leading levels only flip the swap bit, so begin with their parity.
    state, steps = f"(({_STEPS * _BITS} - {z}) & 1)", []
    for i, chunk in zip(reversed(range(_STEPS)), chunks):
        steps.append(f"{values}[cast({state} * {_CELLS} + {chunk} as int)] as _h{i}")
        state = f"(_h{i} & 3)"
    return steps


def _zoom_base(z: str) -> str:
    # (4^z - 1) / 3: the number of tiles on all lower zooms.
    return f"((shiftleft(1L, 2 * {z}) - 1) div 3)"


def _sealed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters, join keys and aggregates refer to by name only.

    Without the one-element explode the optimiser would copy the expression behind
    the column into every filter derived from it.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def with_tile_id(
    df: DataFrame, z: str = "z", x: str = "x", y: str = "y", name: str = "tile_id", strict: bool = False
) -> DataFrame:
    """``df`` with the Hilbert id of the tile in columns z, x, y, computed once per row.

    Zooms beyond 26 and tiles outside their grid: NULL, or an error when ``strict``.
    """
    tile = F.struct(
        F.col(z).cast("int").alias("z"), F.col(x).cast("bigint").alias("x"), F.col(y).cast("bigint").alias("y")
    )
    side = "shiftleft(1L, _t.z)"
    ok = f"_t.z between 0 and {model.MAX_TILE_ZOOM} and _t.x between 0 and {side} - 1 and _t.y between 0 and {side} - 1"
    bad = "cast(raise_error('tile outside zoom 0..26 or outside its grid') as int)" if strict else "null"
    chunks = [
        f"(shiftright(_t.x, {_BITS * i}) & {_SIDE - 1}) * {_SIDE} + (shiftright(_t.y, {_BITS * i}) & {_SIDE - 1})"
        for i in reversed(range(_STEPS))
    ]
    position = " | ".join(
        f"shiftleft(cast(shiftright(_h{i}, 2) as bigint), {2 * _BITS * i})" for i in range(_STEPS)
    )
    walked = _sealed(df, "_t", tile).selectExpr(
        "*", f"if({ok}, _t.z, {bad}) as _z", *_walk(_tables()[0], "_z", chunks)
    )
    ids = walked.withColumn("_id", F.expr(f"{_zoom_base('_z')} + ({position})"))
    return _sealed(ids, name, F.col("_id")).select(*df.columns, name)


def tile_zoom(tid: Column) -> Column:
    """Zoom of a tile id: 3 * id + 1 lies between 4^z and 4^(z+1)."""
    return F.floor((F.length(F.bin(tid * 3 + 1)) - 1) / 2).cast("int")


def with_tile_zxy(df: DataFrame, tid: str = "tile_id", strict: bool = False) -> DataFrame:
    """``df`` with columns z, x, y of a tile id, computed once per row.

    Ids beyond zoom 26: NULL columns, or an error when ``strict``.
    """
    last = (4 ** (model.MAX_TILE_ZOOM + 1) - 1) // 3 - 1
    bad = "cast(raise_error('tile id outside zoom 0..26') as bigint)" if strict else "null"
    position = f"(_ok - {_zoom_base('_z')})"
    chunks = [f"(shiftright({position}, {2 * _BITS * i}) & {_CELLS - 1})" for i in reversed(range(_STEPS))]
    x = " | ".join(f"shiftleft(cast(shiftright(_h{i}, {2 + _BITS}) as bigint), {_BITS * i})" for i in range(_STEPS))
    y = " | ".join(
        f"shiftleft(cast(shiftright(_h{i}, 2) & {_SIDE - 1} as bigint), {_BITS * i})" for i in range(_STEPS)
    )
    checked = _sealed(df, "_id", F.col(tid).cast("bigint")).withColumn(
        "_ok", F.expr(f"if(_id between 0 and {last}L, _id, {bad})")
    )
    walked = checked.withColumn("_z", tile_zoom(F.col("_ok"))).selectExpr(
        "*", *_walk(_tables()[1], "_z", chunks)
    )
    tiles = walked.withColumn("_t", F.expr(f"struct(_z as z, {x} as x, {y} as y)"))
    return _sealed(tiles, "_zxy", F.col("_t")).select(*df.columns, "_zxy.*")
