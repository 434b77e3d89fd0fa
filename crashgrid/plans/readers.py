"""Queries through the readers: a derived input is written once and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from crashgrid.functions import geo
from crashgrid.operators.filters import accident_filter, in_bounds
from crashgrid.model import FilterState
from crashgrid.plans.registry import query
from crashgrid.sources import scans, storage


@query(
    "accident_scan",
    "accidents",
    sql="""select UJAHR, count(*) as n, sum(UART) as kinds from accidents
where UKATEGORIE in (1,2) and IstRad=1 and lon between 8 and 12 and lat between 48 and 53 group by UJAHR""",
)
def accident_scan(load):
    accidents = load("accidents")
    path = storage.new_path(accidents.sparkSession, "accidents")
    accidents.write.parquet(path)
    stored = scans.read_accidents(accidents.sparkSession, path)
    state = FilterState(ukategorie=[1, 2], flags=["IstRad"])
    found = accident_filter(stored, state).where(in_bounds(8.0, 48.0, 12.0, 53.0))
    return found.groupBy("UJAHR").agg(F.count("*").alias("n"), F.sum("UART").alias("kinds"))


@query("accident_csv", "accidents", sql="select * from accidents")
def accident_csv(load):
    accidents = load("accidents")
    path = storage.new_path(accidents.sparkSession, "csv")
    # Coordinates with a decimal comma, under the names of the source, and one column more.
    texts = accidents.select(
        F.lit("x").alias("LAND"),
        F.replace(F.col("lat").cast("string"), F.lit("."), F.lit(",")).alias("YGCSWGS84"),
        F.replace(F.col("lon").cast("string"), F.lit("."), F.lit(",")).alias("XGCSWGS84"),
        *[c for c in reversed(accidents.columns) if c not in ("lon", "lat")],
    )
    texts.write.options(header=True, sep=";").csv(path)
    return scans.read_accidents_csv(accidents.sparkSession, path, coordinates=("XGCSWGS84", "YGCSWGS84"))


@query("image_scan", "images", sql="select id, lon, lat from images where id is not null")
def image_scan(load):
    images = load("images")
    path = storage.new_path(images.sparkSession, "images")
    images.write.parquet(path)
    stored = scans.read_images(images.sparkSession, path)
    return stored.where(F.col("id").isNotNull()).select("id", "lon", "lat")


@query("place_geojson", "places", sql="select place_id, name, city, country, lon, lat from places")
def place_geojson(load):
    """Places as single features and as collections, in one folder each."""
    places = load("places")
    spark = places.sparkSession
    feature = F.struct(
        F.struct("place_id", "name", "city", "country").alias("properties"),
        F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"),
    )
    single, many = storage.new_path(spark, "features"), storage.new_path(spark, "collections")
    odd = F.col("place_id") % 2 == 1
    places.where(odd).select(F.to_json(feature)).write.text(single)
    grouped = places.where(~odd).groupBy((F.col("place_id") / 50).cast("int").alias("g"))
    grouped.agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value")).select("value").write.text(many)
    return scans.read_places_geojson(spark, single).unionByName(scans.read_places_geojson(spark, many))


@query("place_scan", "places", sql="select place_id, name, lon from places where lat between 48 and 50")
def place_scan(load):
    places = load("places")
    path = storage.new_path(places.sparkSession, "places")
    places.write.parquet(path)
    stored = scans.read_places(places.sparkSession, path)
    return stored.where(F.col("lat").between(48, 50)).select("place_id", "name", "lon")


@query(
    "tile_request_log",
    "tile_urls",
    sql="""select case when url like 'pmtiles:%' then cast(split_part(url,'/',5) as int) end as z, count(*) as n
from tile_urls group by z""",
)
def tile_request_log(load):
    urls = load("tile_urls").select("url")
    path = storage.new_path(urls.sparkSession, "log")
    urls.write.text(path)
    asked = scans.read_tile_requests(urls.sparkSession, path)
    parsed = asked.select(geo.parse_tile_url(F.col("url")).alias("p"))
    return parsed.groupBy(F.col("p.z").alias("z")).agg(F.count("*").alias("n"))
