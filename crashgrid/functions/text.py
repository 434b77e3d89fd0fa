"""Small text expressions: place labels, links, code parsing, tile names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crashgrid import model
from crashgrid.functions.codes import lookup


def place_label(name: Column, city: Column, country: Column) -> Column:
    """``name, city`` with the country as fallback; empty strings count as missing."""
    empty = F.lit("")
    where = F.coalesce(F.nullif(city, empty), F.nullif(country, empty), empty)
    return F.concat(F.coalesce(name, empty), F.lit(", "), where)


def image_link(image_id: Column) -> Column:
    """Street-image page of an image id; NULL for a missing or empty id."""
    link = F.concat(F.lit(model.IMAGE_LINK_PREFIX), image_id, F.lit(model.IMAGE_LINK_SUFFIX))
    return F.when(image_id != "", link)


def parse_code(text: Column) -> Column:
    """Leading integer of a text, NULL when there is none or it exceeds INT."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def tile_type_name(t: Column) -> Column:
    return lookup(t, model.TILE_TYPE_NAMES)


def tile_type_ext(t: Column) -> Column:
    """File extension of a tile type, empty for any other code."""
    return F.coalesce(lookup(t, model.TILE_TYPE_EXTENSIONS), F.lit(""))


def tile_type_mime(t: Column) -> Column:
    return lookup(t, model.TILE_TYPE_MIMES)


def compression_name(c: Column) -> Column:
    return lookup(c, model.COMPRESSION_NAMES)
