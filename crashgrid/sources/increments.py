"""A layer store that grows by deltas: a new year is added without reading the old points.

Clusters are kept as whole-number sums per finest cell, in a folder per zone (tile of level
8) and version. Adding points sums them per cell, merges the sums with those of the touched
zones and writes these zones anew under the next version; all other zones stay as they are.
Cells of coarser zooms nest in zones and are summed from the finest ones when read. Points
are added to their two bands as further files, each version sorted by tile id.

A manifest says which version of a zone holds. It is written last, so an addition that
failed is not seen, and repeating it writes the same folders again. Additions to one store
must not run at the same time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashgrid import model
from crashgrid.functions import curve, geo
from crashgrid.operators import clusters as cl
from crashgrid.sources import storage

ZONE_LEVEL = 8
FINEST_ZOOM = 10
CELL_LEVEL = FINEST_ZOOM + cl.CELL_BITS
_CELLS = "cx bigint, cy bigint, n bigint, slon bigint, slat bigint, zone bigint"
_MANIFEST = "zone bigint, version int"


def _zoned(cells: DataFrame) -> DataFrame:
    up = CELL_LEVEL - ZONE_LEVEL
    return cells.withColumn("zone", F.shiftright("cx", up) * (1 << ZONE_LEVEL) + F.shiftright("cy", up))


def last_version(spark: SparkSession, path: str) -> int:
    """Number of the last complete addition, -1 for a new store."""
    done = [n for n in storage.names_in(spark, f"{path}/manifest") if n.startswith("version=")]
    complete = [n for n in done if "_SUCCESS" in storage.names_in(spark, f"{path}/manifest/{n}")]
    return max((int(n.split("=")[1]) for n in complete), default=-1)


def _manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Version that holds of every zone; there are at most 4^8 zones."""
    if version < 0:
        return {}
    return dict(map(tuple, spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/version={version}").collect()))


def _read_cells(spark: SparkSession, path: str, held: dict[int, int]) -> DataFrame:
    if not held:
        return spark.createDataFrame([], _CELLS)
    folders = [f"{path}/cells/version={version}/zone={zone}" for zone, version in sorted(held.items())]
    return spark.read.schema(_CELLS).option("basePath", f"{path}/cells").parquet(*folders).select("cx", "cy", "n", "slon", "slat", "zone")


def add(df: DataFrame, path: str) -> int:
    """Add accidents to the store in ``path``, which may be new; returns the version."""
    spark = df.sparkSession
    before = last_version(spark, path)
    version = before + 1
    held = _manifest(spark, path, before)
    delta = storage.materialise(_zoned(cl.cell_sums(df, CELL_LEVEL)), "delta")
    touched = [r.zone for r in delta.select("zone").distinct().collect()]
    old = _read_cells(spark, path, {z: held[z] for z in touched if z in held})
    sums = [F.sum(c).alias(c) for c in ("n", "slon", "slat")]
    merged = old.unionByName(delta.select(*old.columns)).groupBy("cx", "cy", "zone").agg(*sums)
    # A zone has at most 1,024 cells.
    merged.repartition("zone").write.mode("overwrite").partitionBy("zone").parquet(f"{path}/cells/version={version}")
    _write_points(df, f"{path}/points/version={version}")
    held |= {zone: version for zone in touched}
    table = spark.createDataFrame(list(held.items()), _MANIFEST)
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    storage.discard(delta)
    return version


def _write_points(df: DataFrame, path: str) -> None:
    """Both point bands, one folder each, sorted by tile id; a tile with many points spreads over files."""
    bands = F.array(*[F.struct(F.lit(name).alias("layer"), F.lit(zoom).alias("zoom")) for name, zoom in model.POINT_BANDS])
    located = df.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    each = located.withColumn("_band", F.explode(bands)).select(*df.columns, "_band.*")
    each = each.withColumns({"_col": geo.tile_x(F.col("lon"), F.col("zoom")), "_row": geo.tile_y(F.col("lat"), F.col("zoom"))})
    tiled = curve.with_tile_id(each, "zoom", "_col", "_row").drop("_col", "_row").withColumn("_tie", F.xxhash64("lon", "lat", "OBJECTID"))
    keys = ["layer", "tile_id", "_tie"]
    sorted_rows = tiled.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    sorted_rows.write.mode("overwrite").partitionBy("layer").parquet(path)


def read_clusters(spark: SparkSession, path: str, zooms: range = range(6, FINEST_ZOOM + 1)) -> DataFrame:
    """Clusters of all points added so far: (zoom, cx, cy, lon, lat, point_count)."""
    held = _manifest(spark, path, last_version(spark, path))
    return cl.roll_up(_read_cells(spark, path, held), FINEST_ZOOM, zooms)


def read_points(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """All points of one band; the other band is not read."""
    stored = spark.read.parquet(f"{path}/points")
    return stored.where((F.col("layer") == layer) & (F.col("version") <= last_version(spark, path)))


def order_of(layer: DataFrame) -> DataFrame:
    """Per layer and version of a store how far its files are sorted by tile id.

    ``rows``; ``inversions``, rows whose tile id is below that of the row before them in their
    file; ``overlaps``, files that begin below the end of the file before. Both are 0 in a
    clustered store.
    """
    keys = ["layer", "version"]
    located = layer.select(*keys, "tile_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    back = F.lag("tile_id").over(Window.partitionBy("file").orderBy("at")) > F.col("tile_id")
    files = (
        located.withColumn("back", back)
        .groupBy(*keys, "file")
        .agg(F.count("*").alias("rows"), F.count_if("back").alias("inversions"), F.min("tile_id").alias("low"), F.max("tile_id").alias("high"))
    )
    before = F.max("high").over(Window.partitionBy(*keys).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    totals = files.withColumn("overlaps", (F.col("low") < before).cast("int")).groupBy(*keys)
    return totals.agg(*[F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in ("rows", "inversions", "overlaps")])
