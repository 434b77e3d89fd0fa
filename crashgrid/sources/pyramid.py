"""Write accidents as zoom-banded layers clustered by tile id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrid.functions import curve, geo
from crashgrid.operators import clusters as cl

POINT_LAYER = "accidents"
POINT_LEVEL = 12


def _with_tile(df: DataFrame) -> DataFrame:
    x, y = geo.tile_x(F.col("lon"), F.col("zoom")), geo.tile_y(F.col("lat"), F.col("zoom"))
    return curve.with_tile_id(df.withColumns({"_x": x, "_y": y}), "zoom", "_x", "_y").drop("_x", "_y")


def pyramid_rows(df: DataFrame) -> DataFrame:
    """Rows of all layers: both cluster layers and the accident points, with tile_id."""
    clusters = cl.cluster_pyramid(df)
    clusters = clusters.select(
        cl.cluster_layer(F.col("zoom")).alias("layer"),
        "zoom",
        "lon",
        "lat",
        "point_count",
    )
    points = df.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).withColumns(
        {"layer": F.lit(POINT_LAYER), "zoom": F.lit(POINT_LEVEL)}
    )
    return _with_tile(clusters).unionByName(_with_tile(points), allowMissingColumns=True)


def write_pyramid(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write all layers below ``path``, one folder per layer, sorted by tile id.

    Rows are range-partitioned by layer, tile and a hash of the row, so one tile
    with very many points spreads over several files and files keep narrow tile
    ranges for min/max skipping.
    """
    rows = pyramid_rows(df).withColumn("_h", F.xxhash64("lon", "lat", "OBJECTID"))
    keys = ["layer", "tile_id", "_h"]
    placed = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    placed.sortWithinPartitions(*keys).drop("_h").write.mode("overwrite").partitionBy(
        "layer"
    ).parquet(path)
