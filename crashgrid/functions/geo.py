"""Web Mercator projections, tile addresses and viewports as column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from crashgrid import model

MAX_LAT = 85.05112878
TILE_PX = 512


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def world_x(lon: Column) -> Column:
    """Mercator x in 0..1, west to east."""
    return (lon + 180.0) / 360.0


def world_y(lat: Column) -> Column:
    """Mercator y in 0..1, north to south."""
    phi = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT)))
    return (1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0


def world_lon(x: Column) -> Column:
    return x * 360.0 - 180.0


def world_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y))))


def grid_index(world: Column, z: Column | int) -> Column:
    """Cell number of a 0..1 coordinate at level z, clamped to the grid."""
    n = F.lit(float(1 << z)) if isinstance(z, int) else F.pow(F.lit(2.0), z)
    cell = F.floor(world * n)
    return F.greatest(F.least(cell, (n - 1.0).cast("bigint")), F.lit(0).cast("bigint"))


def tile_x(lon: Column, z: Column | int) -> Column:
    return grid_index(world_x(lon), z)


def tile_y(lat: Column, z: Column | int) -> Column:
    return grid_index(world_y(lat), z)


def lonlat_to_tile(lon: Column, lat: Column, z: Column | int) -> Column:
    """Struct (x, y) of the tile that holds a point at level z."""
    return F.struct(tile_x(lon, z).alias("x"), tile_y(lat, z).alias("y"))


def bounds_struct(minlon: Column, minlat: Column, maxlon: Column, maxlat: Column) -> Column:
    return F.struct(
        minlon.alias("minlon"), minlat.alias("minlat"), maxlon.alias("maxlon"), maxlat.alias("maxlat")
    )


def tile_bounds(z: Column | int, x: Column, y: Column) -> Column:
    """Struct (minlon, minlat, maxlon, maxlat) of a tile."""
    n = F.lit(float(1 << z)) if isinstance(z, int) else F.pow(F.lit(2.0), z)
    return bounds_struct(
        world_lon(x / n), world_lat((y + 1) / n), world_lon((x + 1) / n), world_lat(y / n)
    )


def viewport_bounds(lon: Column, lat: Column, zoom: Column, width, height) -> Column:
    """Bounds of a view of width x height px; the world is 512 * 2^zoom px wide."""
    world_px = F.lit(float(TILE_PX)) * F.pow(F.lit(2.0), zoom)
    half_w, half_h = _lit(width) / 2.0 / world_px, _lit(height) / 2.0 / world_px
    x, y = world_x(lon), world_y(lat)
    return bounds_struct(
        world_lon(x - half_w), world_lat(y + half_h), world_lon(x + half_w), world_lat(y - half_h)
    )


def bounds_valid(minlon: Column, minlat: Column, maxlon: Column, maxlat: Column) -> Column:
    """False when either extent is empty or inverted."""
    return ~((minlon >= maxlon) | (minlat >= maxlat))


def clamp_zoom(zoom: Column, lo: float = model.ZOOM_RANGE[0], hi: float = model.ZOOM_RANGE[1]) -> Column:
    return F.least(F.greatest(zoom, F.lit(lo)), F.lit(hi))


def fixed_point_deg(i: Column) -> Column:
    """Degrees of a coordinate stored as an integer scaled by 1e7."""
    return i / F.lit(1e7)


def tile_url(z: Column, x: Column, y: Column, template: str) -> Column:
    """A URL template with {z}, {x} and {y} filled in."""
    values = {"{z}": z, "{x}": x, "{y}": y}
    parts = [p for p in re.split(r"(\{[zxy]\})", template) if p]
    return F.concat(*[values[p].cast("string") if p in values else F.lit(p) for p in parts])


def parse_tile_url(url: Column) -> Column:
    """Struct (archive, z, x, y) of a tile URL; NULL when the URL does not match."""

    def part(i: int) -> Column:
        return F.regexp_extract(url, model.TILE_URL_PATTERN, i)

    parsed = F.struct(
        part(1).alias("archive"),
        part(2).try_cast("int").alias("z"),
        part(3).try_cast("bigint").alias("x"),
        part(4).try_cast("bigint").alias("y"),
    )
    return F.when(url.rlike(model.TILE_URL_PATTERN), parsed)
