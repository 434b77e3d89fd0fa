"""Readers for accident, cluster, image, place and tile tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashgrid import model


def read_accidents(spark: SparkSession, path: str) -> DataFrame:
    """Accident points from Parquet with the fixed schema."""
    return spark.read.schema(model.ACCIDENT).parquet(path)


def read_accidents_csv(
    spark: SparkSession, path: str, sep: str = ";", coordinates: tuple[str, str] = ("lon", "lat"), **options
) -> DataFrame:
    """Accident points from delimited text with a header; unknown columns are ignored.

    Columns are matched by header name. All files of one call must have the same header,
    else reading fails; union the calls for files of different years. ``coordinates``
    names the columns of lon and lat where they differ; a file without them is refused.
    Values that are not numbers become NULL, and a decimal comma is accepted in the
    coordinates.
    """
    raw = spark.read.options(header=True, sep=sep, inferSchema=False, enforceSchema=False, **options).csv(path)
    present = {c.lower(): c for c in raw.columns}
    for name, source in zip(("lon", "lat"), coordinates, strict=True):
        if source.lower() not in present:
            raise ValueError(f"no column {source} in {path}")
        present[name] = present[source.lower()]
    columns = []
    for field in model.ACCIDENT:
        source = present.get(field.name.lower())
        if source is None:
            text = F.lit(None).cast("string")
        else:
            text = F.trim(raw[source])
        if field.dataType == T.DoubleType():
            text = F.replace(text, F.lit(","), F.lit("."))
        columns.append(text.try_cast(field.dataType).alias(field.name))
    return raw.select(*columns)


def read_layer(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """One named layer of a store partitioned by ``layer``; other layers are pruned."""
    return spark.read.parquet(path).where(F.col("layer") == layer)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(model.IMAGE).parquet(path)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(model.PLACE).parquet(path)


_PLACE_FEATURE = (
    "properties: struct<place_id: bigint, name: string, city: string, country: string>, "
    "geometry: struct<coordinates: array<double>>"
)
_PLACE_DOCUMENT = f"struct<{_PLACE_FEATURE}, features: array<struct<{_PLACE_FEATURE}>>>"


def places_from_geojson(features: DataFrame, column: str = "value") -> DataFrame:
    """Flat places from GeoJSON in ``column``: a point feature or a FeatureCollection per row."""
    parsed = features.select(F.from_json(F.col(column), _PLACE_DOCUMENT).alias("d"))
    single = F.array(F.struct("d.properties", "d.geometry"))
    f = parsed.select(F.explode(F.coalesce("d.features", single)).alias("f"))
    xy = F.col("f.geometry.coordinates")
    return f.select("f.properties.*", F.get(xy, F.lit(0)).alias("lon"), F.get(xy, F.lit(1)).alias("lat"))


def read_places_geojson(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Places from newline-delimited GeoJSON; ``whole`` reads every file as one document."""
    return places_from_geojson(spark.read.text(path, wholetext=whole))


def read_tile_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request log with one tile URL per line."""
    return spark.read.text(path).select(F.col("value").alias("url"))
