"""Cluster points: one point per Web Mercator cell, for one zoom or a pyramid of zooms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashgrid import model
from crashgrid.functions import geo

CELL_BITS = 3
DEGREE_UNITS = 10_000_000
SCHEMA = "zoom int, cx bigint, cy bigint, lon double, lat double, point_count bigint"


def _units(degrees: str) -> Column:
    """Coordinate as an integer of 1e-7 degrees.

    Integer sums do not depend on the order of the rows, so a centre comes out
    the same however the points are partitioned or recomputed.
    """
    return F.round(F.col(degrees) * DEGREE_UNITS).cast("bigint")


def cell_sums(df: DataFrame, level: int) -> DataFrame:
    """Points per cell of a level as whole-number sums: (cx, cy, n, slon, slat)."""
    located = df.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    cell = [geo.tile_x(F.col("lon"), level).alias("cx"), geo.tile_y(F.col("lat"), level).alias("cy")]
    return (
        located.select(*cell, _units("lon").alias("lon"), _units("lat").alias("lat"))
        .groupBy("cx", "cy")
        .agg(F.count("*").alias("n"), F.sum("lon").alias("slon"), F.sum("lat").alias("slat"))
    )


def _points(cells: DataFrame) -> DataFrame:
    return cells.select(
        "zoom",
        "cx",
        "cy",
        (F.col("slon") / F.col("n") / DEGREE_UNITS).alias("lon"),
        (F.col("slat") / F.col("n") / DEGREE_UNITS).alias("lat"),
        F.col("n").alias("point_count"),
    )


def cluster_points(df: DataFrame, zoom: int, cell_bits: int = CELL_BITS) -> DataFrame:
    """Clusters of one zoom: (zoom, cx, cy, lon, lat, point_count), centred on the mean."""
    return _points(cell_sums(df, zoom + cell_bits).withColumn("zoom", F.lit(zoom)))


def cluster_pyramid(
    df: DataFrame, zooms: range = range(6, 11), cell_bits: int = CELL_BITS
) -> DataFrame:
    """Clusters of several zooms from one pass over the points.

    Only the finest level reads the points. The coarser ones re-aggregate its
    cells, whose number does not grow with the points.
    """
    finest = max(zooms)
    return roll_up(cell_sums(df, finest + cell_bits), finest, zooms)


def roll_up(base: DataFrame, finest: int, zooms: range) -> DataFrame:
    """Clusters of several zooms from the ``cell_sums`` of the zoom ``finest``."""
    ancestors = [
        F.struct(
            F.lit(z).alias("zoom"),
            F.shiftright("cx", finest - z).alias("cx"),
            F.shiftright("cy", finest - z).alias("cy"),
        )
        for z in zooms
    ]
    rolled = (
        base.select(F.explode(F.array(*ancestors)).alias("c"), "n", "slon", "slat")
        .groupBy("c.zoom", "c.cx", "c.cy")
        .agg(F.sum("n").alias("n"), F.sum("slon").alias("slon"), F.sum("slat").alias("slat"))
    )
    return _points(rolled)


def cluster_layer(zoom: Column) -> Column:
    """Name of the cluster layer shown at a zoom."""
    return F.when(zoom < 9, F.lit(model.COARSE_LAYER)).otherwise(F.lit(model.FINE_LAYER))


def draw_order(clusters: DataFrame) -> DataFrame:
    """Clusters with the largest last, so that they are drawn on top."""
    return clusters.orderBy("point_count", "cx", "cy")


def visible_cluster_total(clusters: DataFrame, condition: Column | None = None) -> DataFrame:
    """Sum of point_count of the clusters in view; 0 when there are none."""
    shown = clusters if condition is None else clusters.where(condition)
    total = F.sum(F.coalesce(F.col("point_count"), F.lit(0)))
    return shown.agg(F.coalesce(total, F.lit(0).cast("bigint")).alias("total"))
