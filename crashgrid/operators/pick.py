"""The accident under the cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashgrid import model
from crashgrid.functions import geo
from crashgrid.operators import tree
from crashgrid.operators.skew import sized_join

#: World units (0..1) far above rounding and far below a pixel.
SLACK = 1e-12
CURSOR = ["lon", "lat", "zoom"]
_KEY = ["c_lon", "c_lat", "zoom"]


def pick(
    cursors: DataFrame,
    df: DataFrame | None,
    radius_px: float = model.PICK_RADIUS_PX,
    min_zoom: float = model.CLUSTER_ZOOM_LIMIT,
    index: tree.Tree | None = None,
) -> DataFrame:
    """Cursors (lon, lat, zoom) with the nearest accident within the pixel radius.

    Adds OBJECTID and distance_px; equally near accidents go by OBJECTID. A cursor descends
    the tree of accidents (``index``, or built from ``df``). On each level a node stays when
    it reaches into the radius and its nearest edge beats the farthest corner of every
    other node of the cursor; a node whose points lie on one spot is settled by its
    least id. So a cursor opens a few leaves, however crowded the place is.
    """
    index = index or tree.build(df.select("OBJECTID", "lon", "lat"))
    points = index.points.select(F.col("leaf").alias("key"), F.struct("lon", "lat", F.col("OBJECTID").alias("first_id")).alias("point"))
    here = F.hypot(geo.world_x(F.col("here.lon")) - F.col("wx"), geo.world_y(F.col("here.lat")) - F.col("wy"))
    best = (
        _keyed(candidates(cursors, index, radius_px, min_zoom))
        .join(points, "key", "left")
        .select(*_KEY, "px_per_world", "wx", "wy", F.coalesce("spot", "point").alias("here"))
        .withColumn("distance_px", here * F.col("px_per_world"))
        .where(F.col("distance_px") <= radius_px)
        .groupBy(*_KEY)
        .agg(F.min(F.struct("distance_px", F.col("here.first_id").alias("first_id"))).alias("best"))
        .select(
            F.col("c_lon").alias("lon"),
            F.col("c_lat").alias("lat"),
            "zoom",
            F.col("best.first_id").alias("OBJECTID"),
            F.col("best.distance_px").alias("distance_px"),
        )
    )
    return sized_join(cursors, best, CURSOR)


def candidates(cursors: DataFrame, index: tree.Tree, radius_px: float, min_zoom: float) -> DataFrame:
    """Per distinct cursor the leaves (``at``) and settled spots that may hold its nearest point."""
    px = F.lit(float(geo.TILE_PX)) * F.pow(F.lit(2.0), F.col("zoom"))
    spots = (
        cursors.where(F.col("zoom") >= min_zoom)
        .select(*CURSOR)
        .distinct()
        .select(
            F.col("lon").alias("c_lon"),
            F.col("lat").alias("c_lat"),
            "zoom",
            px.alias("px_per_world"),
            geo.world_x(F.col("lon")).alias("wx"),
            geo.world_y(F.col("lat")).alias("wy"),
        )
    )
    wx, wy, zero = F.col("wx"), F.col("wy"), F.lit(0.0)
    reach = F.lit(radius_px) / F.col("px_per_world") + SLACK
    x0, x1, y0, y1 = F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1")
    nearest = F.hypot(F.greatest(x0 - wx, wx - x1, zero), F.greatest(y0 - wy, wy - y1, zero))
    farthest = F.hypot(F.greatest(F.abs(x0 - wx), F.abs(x1 - wx)), F.greatest(F.abs(y0 - wy), F.abs(y1 - wy)))
    columns = [*_KEY, "px_per_world", "wx", "wy"]
    of_cursor = Window.partitionBy(*_KEY)
    frontier = tree.at_root(spots).withColumn("spot", F.lit(None).cast("struct<lon double, lat double, first_id bigint>"))
    for nodes in index.levels:
        children = nodes.select(
            F.col("parent").alias("key"),
            "node",
            geo.world_x(F.col("node_minlon")).alias("x0"),
            geo.world_x(F.col("node_maxlon")).alias("x1"),
            geo.world_y(F.col("node_maxlat")).alias("y0"),
            geo.world_y(F.col("node_minlat")).alias("y1"),
            F.when(
                F.expr("node_minlon = node_maxlon and node_minlat = node_maxlat"),
                F.struct(F.col("node_minlon").alias("lon"), F.col("node_minlat").alias("lat"), "first_id"),
            ).alias("node_spot"),
        )
        hit = _keyed(frontier).join(children, "key", "left").where("spot is not null or node is not null")
        known = F.hypot(geo.world_x(F.col("spot.lon")) - wx, geo.world_y(F.col("spot.lat")) - wy)
        frontier = (
            hit.select(
                *columns,
                F.coalesce("node", "at").alias("at"),
                F.coalesce("spot", "node_spot").alias("spot"),
                F.coalesce(known, nearest).alias("nearest"),
                F.coalesce(known, farthest).alias("farthest"),
            )
            .where(F.col("nearest") <= reach)
            .withColumn("_bound", F.min("farthest").over(of_cursor))
            .where(F.col("nearest") <= F.col("_bound") + SLACK)
            .select(*columns, "at", "spot")
        )
    return frontier


def _keyed(frontier: DataFrame) -> DataFrame:
    """Join key: the node to open, or for settled rows a hash that matches nothing."""
    spread = f"-1 - pmod(xxhash64({', '.join(_KEY)}), {1 << 20})"
    return frontier.withColumn("key", F.expr(f"if(spot is null, at, {spread})"))
