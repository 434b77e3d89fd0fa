"""Points summed on a nested grid, the index behind view counts and picking.

Levels step by three zooms, so a cell has at most 64 children. A query area is
compared with the children of the few cells it touches, level by level: a child
wholly inside adds its count, one on the edge is opened at the next level. The
rows a query area produces therefore depend on its outline, not on how many
points lie in it, and a cell that holds a third of all points is one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crashgrid.functions import geo

STEP = 3
LEVELS = (14, 17, 20)
FINEST = LEVELS[-1]
ZONE_LEVEL = 8
POINT_SCHEMA = "px bigint, py bigint, lon double, lat double, n bigint, first_id bigint, zone bigint"
CELL_SCHEMA = "px bigint, py bigint, x bigint, y bigint, cell_n bigint, zone bigint"
# Slack in world units (0..1) around cell edges: far above rounding error, far
# below a cell. Cells this close to an edge are opened and settled exactly.
SLACK = 1e-12


@dataclass(frozen=True)
class Grid:
    """``points``: distinct coordinates (px, py, lon, lat, n, first_id) with their finest
    cell. ``cells``: per level the counts (px, py, x, y, cell_n) keyed by parent cell."""

    points: DataFrame
    cells: dict[int, DataFrame]


def build(df: DataFrame) -> Grid:
    """The index of a table of accidents, as a plan."""
    points = positions(df)
    levels = {FINEST: finest_cells(points)}
    for level in reversed(LEVELS[:-1]):
        levels[level] = coarser_cells(levels[level + STEP])
    return Grid(points, levels)


def _zone(px: str, py: str, level: int) -> Column:
    up = level - ZONE_LEVEL
    return F.shiftright(px, up) * (1 << ZONE_LEVEL) + F.shiftright(py, up)


def write_grid(df: DataFrame, path: str) -> None:
    """Store the index below ``path``, partitioned by zone (tiles of level 8)."""
    spark = df.sparkSession
    _write(positions(df), FINEST, f"{path}/points")
    counts = finest_cells(spark.read.schema(POINT_SCHEMA).parquet(f"{path}/points"))
    for level in reversed(LEVELS):
        _write(counts, level - STEP, f"{path}/cells-{level}")
        counts = coarser_cells(spark.read.schema(CELL_SCHEMA).parquet(f"{path}/cells-{level}"))


def _write(table: DataFrame, key_level: int, path: str) -> None:
    # Range partitions by zone and cell: a crowded zone is split over several files.
    keys = ["zone", "px", "py"]
    placed = table.withColumn("zone", _zone("px", "py", key_level)).repartitionByRange(*keys)
    placed.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("zone").parquet(path)


def read_grid(spark: SparkSession, path: str, zones: list[int] | None = None) -> Grid:
    """A stored index, restricted to some zones if given; other zones are not read."""

    def table(name: str, schema: str) -> DataFrame:
        stored = spark.read.schema(schema).parquet(f"{path}/{name}")
        kept = stored if zones is None else stored.where(F.col("zone").isin(zones))
        return kept.drop("zone")

    counts = {level: table(f"cells-{level}", CELL_SCHEMA) for level in LEVELS}
    return Grid(table("points", POINT_SCHEMA), counts)


def zones_of(boxes: DataFrame) -> list[int]:
    """Zones that world boxes touch. There are at most 4^8 zones, however many boxes."""
    touched = cover(boxes.select("wx0", "wy0", "wx1", "wy1"), ZONE_LEVEL)
    zones = touched.select(_zone("px", "py", ZONE_LEVEL).alias("zone")).distinct()
    return [row.zone for row in zones.collect()]


def positions(df: DataFrame) -> DataFrame:
    """Distinct coordinates (px, py, lon, lat, n, first_id) with their finest cell."""
    distinct = (
        df.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
        .groupBy("lon", "lat")
        .agg(F.count("*").alias("n"), F.min("OBJECTID").alias("first_id"))
    )
    return distinct.select(
        geo.tile_x(F.col("lon"), FINEST).alias("px"),
        geo.tile_y(F.col("lat"), FINEST).alias("py"),
        "lon",
        "lat",
        "n",
        "first_id",
    )


def finest_cells(points: DataFrame) -> DataFrame:
    """Counts (px, py, x, y, cell_n) of the finest level, keyed by the parent cell."""
    counts = points.groupBy(F.col("px").alias("x"), F.col("py").alias("y"))
    return _with_parent(counts.agg(F.sum("n").alias("cell_n")))


def coarser_cells(children: DataFrame) -> DataFrame:
    """The next coarser level, summed from the cells below it instead of the points."""
    counts = children.groupBy(F.col("px").alias("x"), F.col("py").alias("y"))
    return _with_parent(counts.agg(F.sum("cell_n").alias("cell_n")))


def _with_parent(counts: DataFrame) -> DataFrame:
    parent = [F.shiftright("x", STEP).alias("px"), F.shiftright("y", STEP).alias("py")]
    return counts.select(*parent, "x", "y", "cell_n")


def world_box(bounds: Column) -> list[Column]:
    """The bounds as world coordinates (wx0, wy0, wx1, wy1); y grows to the south."""
    return [
        geo.world_x(bounds["minlon"]).alias("wx0"),
        geo.world_y(bounds["maxlat"]).alias("wy0"),
        geo.world_x(bounds["maxlon"]).alias("wx1"),
        geo.world_y(bounds["minlat"]).alias("wy1"),
    ]


def cover(boxes: DataFrame, level: int | Column) -> DataFrame:
    """Cells (px, py) of one level that each world box touches."""

    def span(lo: str, hi: str) -> Column:
        first = geo.grid_index(F.col(lo) - SLACK, level)
        return F.explode(F.sequence(first, geo.grid_index(F.col(hi) + SLACK, level)))

    return boxes.withColumn("px", span("wx0", "wx1")).withColumn("py", span("wy0", "wy1"))


def edges(level: int) -> tuple[Column, Column, Column, Column]:
    """World edges (x0, y0, x1, y1) of the cell in columns x, y."""
    return tuple(F.expr(e) for e in _edges(level))


def _edges(level: int) -> tuple[str, str, str, str]:
    side = f"{1 << level}D"
    return f"x / {side}", f"y / {side}", f"(x + 1) / {side}", f"(y + 1) / {side}"


def apart(level: int) -> str:
    """Condition: the cell x, y lies outside the world box, beyond doubt."""
    x0, y0, x1, y1 = _edges(level)
    s = f"{SLACK}D"
    return f"({x1} < wx0 - {s} or {x0} > wx1 + {s} or {y1} < wy0 - {s} or {y0} > wy1 + {s})"


def inside(level: int) -> str:
    """Condition: the cell x, y lies wholly inside the world box, beyond doubt."""
    x0, y0, x1, y1 = _edges(level)
    s = f"{SLACK}D"
    return f"({x0} > wx0 + {s} and {x1} < wx1 - {s} and {y0} > wy0 + {s} and {y1} < wy1 - {s})"
