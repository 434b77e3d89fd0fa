"""The layer registry, its visibility rules and unions of layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crashgrid import model


def layer_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        model.LAYERS,
        "layer_id string, source string, source_layer string, "
        "minzoom double, maxzoom double, visible boolean",
    )


def visible_layers(
    views: DataFrame, zoom: Column | str = "zoom", toggles: dict[str, bool] | None = None
) -> DataFrame:
    """One row per view and visible layer: the zoom lies in [minzoom, maxzoom) and it is on.

    Limits are those of the layers; a source that ends earlier shows its deepest tiles.
    ``toggles`` overrides the visibility at load per layer id. The registry has
    eight rows, so each view row expands into at most eight.
    """
    zoom = F.col(zoom) if isinstance(zoom, str) else zoom
    toggles = toggles or {}
    candidates = []
    for layer_id, _, source_layer, lo, hi, visible in model.LAYERS:
        if toggles.get(layer_id, visible):
            shown = F.lit(True) if lo is None else zoom >= lo
            shown = shown if hi is None else shown & (zoom < hi)
            row = F.struct(F.lit(layer_id).alias("layer_id"), F.lit(source_layer).alias("source_layer"))
            candidates.append(F.when(shown, row))
    layers = F.array_compact(F.array(*candidates))
    return views.withColumn("_layer", F.explode(layers)).select(*views.columns, "_layer.*")


def union_layers(*layers: DataFrame) -> DataFrame:
    """Bag union of layers by column name."""
    return reduce(DataFrame.unionByName, layers)


def layer_fields(df: DataFrame, layer: str = "layer") -> DataFrame:
    """Per layer the sorted names of all attributes that occur with a value."""
    attributes = sorted(c for c in df.columns if c != layer)
    seen = df.groupBy(layer).agg(*[F.bool_or(F.col(a).isNotNull()).alias(a) for a in attributes])
    names = F.array_compact(F.array(*[F.when(F.col(a), F.lit(a)) for a in attributes]))
    return seen.select(layer, names.alias("fields"))
