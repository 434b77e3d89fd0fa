"""Queries on tile addresses, tile requests and run-length tile tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from crashgrid.functions import curve, geo
from crashgrid.operators import layers, tiles
from crashgrid.plans.registry import query
from crashgrid.plans.sqltext import hilbert, tile_x, tile_y, unhilbert

TEMPLATE = "https://tiles.example/{z}/{x}/{y}.mvt?key=none"
_PATTERN = r"pmtiles://(.+)/(\d+)/(\d+)/(\d+)"
_PARSED = rf"""
parsed as (
  select request_id, url, nullif(regexp_extract(url, '{_PATTERN}', 1), '') as archive,
    try_cast(regexp_extract(url, '{_PATTERN}', 2) as int) as z,
    try_cast(regexp_extract(url, '{_PATTERN}', 3) as bigint) as x,
    try_cast(regexp_extract(url, '{_PATTERN}', 4) as bigint) as y,
    not regexp_matches(url, '{_PATTERN}') as bad_url
  from tile_urls)"""


@query(
    "parse_tile_urls",
    "tile_urls",
    ctes=(_PARSED, hilbert("parsed")),
    sql="""select request_id, archive, p.z, p.x, p.y, bad_url, i.tile_id
from parsed p left join ids i on i.z=p.z and i.x=p.x and i.y=p.y""",
)
def parse_tile_urls(load):
    return tiles.parse_requests(load("tile_urls")).drop("url")


_GRID = f"""
grid as (
  select OBJECTID, lon, lat, z, {tile_x('lon', 'power(2e0,z)')} as x, {tile_y('lat', 'power(2e0,z)')} as y
  from (select OBJECTID, lon, lat, cast(abs(OBJECTID%16) as int) as z from accidents))"""


@query(
    "accident_tile_ids",
    "accidents",
    ctes=(_GRID, hilbert("grid")),
    sql="""select OBJECTID, g.z, g.x, g.y, tile_id from grid g join ids i on i.z=g.z and i.x=g.x and i.y=g.y""",
)
def accident_tile_ids(load):
    z = F.abs(F.col("OBJECTID") % 16).cast("int")
    located = load("accidents").select("OBJECTID", "lon", "lat", z.alias("z"))
    tile = geo.lonlat_to_tile(F.col("lon"), F.col("lat"), F.col("z"))
    placed = located.select("OBJECTID", "z", tile.alias("t")).select("OBJECTID", "z", "t.*")
    return curve.with_tile_id(placed)


@query(
    "tile_id_inverse",
    "tile_requests tile_entries",
    ctes=(
        "all_ids as (select tile_id from tile_requests union all select tile_id*1000003 from tile_entries)",
        unhilbert("all_ids"),
    ),
    sql="select a.tile_id, z, x, y from all_ids a join zxy on zxy.tile_id=a.tile_id",
)
def tile_id_inverse(load):
    far = load("tile_entries").select((F.col("tile_id") * 1000003).alias("tile_id"))
    ids = load("tile_requests").select("tile_id").unionByName(far)
    return curve.with_tile_zxy(ids)


_BOUNDS = """
tb as (
  select request_id, z, x, y, x/power(2e0,z)*360-180 as minlon,
    degrees(atan(sinh(pi()*(1-2*(y+1)/power(2e0,z))))) as minlat,
    (x+1)/power(2e0,z)*360-180 as maxlon, degrees(atan(sinh(pi()*(1-2*y/power(2e0,z))))) as maxlat
  from parsed where z is not null)"""


@query(
    "tile_bounds",
    "tile_urls",
    ctes=(_PARSED, _BOUNDS),
    sql="""select request_id, round(minlon,6) as minlon, round(minlat,6) as minlat, round(maxlon,6) as maxlon,
  round(maxlat,6) as maxlat, not (minlon>=maxlon or minlat>=maxlat) as valid,
  not (maxlon>=minlon or minlat>=maxlat) as valid_swapped,
  'https://tiles.example/' || z || '/' || x || '/' || y || '.mvt?key=none' as tile_url from tb""",
)
def tile_bounds(load):
    parsed = tiles.parse_requests(load("tile_urls")).where(~F.col("bad_url"))
    b = geo.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    sides = ["minlon", "minlat", "maxlon", "maxlat"]
    rows = parsed.select("request_id", "z", "x", "y", b.alias("b")).select("*", "b.*")
    return rows.select(
        "request_id",
        *[F.round(s, 6).alias(s) for s in sides],
        geo.bounds_valid(*[F.col(s) for s in sides]).alias("valid"),
        geo.bounds_valid(F.col("maxlon"), F.col("minlat"), F.col("minlon"), F.col("maxlat")).alias(
            "valid_swapped"
        ),
        geo.tile_url(F.col("z"), F.col("x"), F.col("y"), TEMPLATE).alias("tile_url"),
    )


@query(
    "fixed_point_degrees",
    "tile_entries",
    sql="select tile_id, cast(data_offset*100-90000000 as int)/1e7 as deg from tile_entries",
)
def fixed_point_degrees(load):
    # Not narrowed to 32 bits: offsets from 22 MB on would not fit.
    fixed = F.col("data_offset") * 100 - 90000000
    return load("tile_entries").select("tile_id", geo.fixed_point_deg(fixed).alias("deg"))


_ASOF = """
hits as (
  select r.request_id, r.tile_id, e.tile_id as run_start, e.run_length, e.data_offset, e.data_length
  from tile_requests r asof join tile_entries e on r.tile_id>=e.tile_id
  where r.tile_id-e.tile_id<e.run_length)"""


@query("tile_lookup", "tile_entries tile_requests", ctes=(_ASOF,), sql="select * from hits")
def tile_lookup(load):
    return tiles.tile_lookup(load("tile_requests"), load("tile_entries"))


@query(
    "missing_tiles",
    "tile_entries tile_requests",
    ctes=(_ASOF,),
    sql="select * from tile_requests where request_id not in (select request_id from hits)",
)
def missing_tiles(load):
    return tiles.missing_tiles(load("tile_requests"), load("tile_entries"))


@query(
    "resolve_tile_urls",
    "tile_urls tile_entries",
    ctes=(
        _PARSED,
        hilbert("parsed"),
        """runs as (
  select 1365+(tile_id-1398101)//7*2801 as tile_id, 1+(run_length-1)*461 as run_length, data_offset from tile_entries)""",
        """asked as (
  select request_id, p.z, i.tile_id from parsed p join ids i on i.z=p.z and i.x=p.x and i.y=p.y
  where p.z between 6 and 11)""",
    ),
    sql="""select a.request_id, a.z, a.tile_id, r.tile_id as run_start, r.run_length, r.data_offset
from asked a asof join runs r on a.tile_id>=r.tile_id where a.tile_id-r.tile_id<r.run_length""",
)
def resolve_tile_urls(load):
    runs = load("tile_entries").select(
        (F.expr("(tile_id - 1398101) div 7 * 2801") + 1365).alias("tile_id"),
        ((F.col("run_length") - 1) * 461 + 1).alias("run_length"),
        "data_offset",
    )
    hits = tiles.resolve_urls(load("tile_urls"), runs, 6, 11)
    return hits.select("request_id", "z", "tile_id", "run_start", "run_length", "data_offset")


_RUNS = """
marked as (select *, tile_id-row_number() over (partition by content order by tile_id) as g from tile_contents),
runs as (select min(tile_id) as tile_id, count(*) as run_length, content from marked group by content, g)"""


@query("compact_runs", "tile_contents", ctes=(_RUNS,), sql="select * from runs")
def compact_runs(load):
    return tiles.compact_runs(load("tile_contents"))


@query(
    "expand_runs",
    "tile_entries",
    sql="""select unnest(generate_series(tile_id, tile_id+run_length-1)) as tile_id, data_offset, data_length
from tile_entries""",
)
def expand_runs(load):
    return tiles.expand_runs(load("tile_entries"))


@query("compact_expand_round_trip", "tile_contents", sql="select tile_id, content from tile_contents")
def compact_expand_round_trip(load):
    return tiles.expand_runs(tiles.compact_runs(load("tile_contents")))


# Zoom of a tile id: the number of ids on all levels above is (4^z - 1) / 3.
_SPREAD = """
spread as (select tile_id*(1+data_offset//1000%37) as tile_id, run_length, data_length from tile_entries),
starts as (select z, cast((power(4,z)-1)/3 as bigint) as first from generate_series(0,26) t(z)),
ends as (select min(tile_id) as lo, max(tile_id+run_length-1) as hi from spread),
zooms as (select (select max(z) from starts where first<=lo) as minzoom, (select max(z) from starts where first<=hi) as maxzoom from ends)"""
_SUMMARY = """
summary as (
select cast(sum(run_length) as bigint) as addressed_tiles, count(*) as tile_entries,
  count(distinct data_length) as tile_contents, minzoom, maxzoom, minlon, minlat, maxlon, maxlat,
  (minlon+maxlon)/2 as center_lon, (minlat+maxlat)/2 as center_lat, minzoom as center_zoom
from spread, zooms, (select min(lon) as minlon, min(lat) as minlat, max(lon) as maxlon, max(lat) as maxlat from accidents)
group by all)"""


def _spread(load):
    """Tile entries moved to ids on several zooms."""
    factor = F.expr("1 + data_offset div 1000 % 37")
    return load("tile_entries").withColumn("tile_id", F.col("tile_id") * factor)


@query("tileset_summary", "tile_entries accidents", ctes=(_SPREAD, _SUMMARY), sql="select * from summary")
def tileset_summary(load):
    return tiles.tileset_summary(_spread(load), load("accidents"), content="data_length")


@query(
    "tilejson",
    "tile_entries accidents",
    ctes=(
        _SPREAD,
        _SUMMARY,
        """named as (select case when UART is null then 'no_kind' else 'full' end as layer, * from accidents),
attrs as (select distinct layer, 'UART' as a from named where UART is not null
  union all select distinct layer, 'lon' from named where lon is not null)""",
    ),
    sql="""select '3.0.0' as version, 'https://tiles.example/{z}/{x}/{y}.mvt' as tiles, 'accidents' as name,
  cast(null as varchar) as attribution, minzoom, maxzoom, minlon, maxlat, center_lon, cast(center_zoom as double) as center_zoom,
  (select string_agg(layer || ':' || f, ';' order by layer) from (select layer, string_agg(a, ',' order by a) as f from attrs group by layer)) as layers
from summary""",
)
def tilejson(load):
    layer = F.when(F.col("UART").isNull(), F.lit("no_kind")).otherwise(F.lit("full"))
    fields = layers.layer_fields(load("accidents").select(layer.alias("layer"), "UART", "lon"))
    summary = tiles.tileset_summary(_spread(load), load("accidents"), content="data_length")
    doc = tiles.tilejson(summary, "https://tiles.example", 1, fields, {"name": "accidents"})
    named = F.transform(
        "tilejson.vector_layers", lambda x: F.concat(x["id"], F.lit(":"), F.array_join(x["fields"], ","))
    )
    return doc.select(
        F.col("tilejson.tilejson").alias("version"),
        F.get("tilejson.tiles", F.lit(0)).alias("tiles"),
        "tilejson.name",
        "tilejson.attribution",
        "tilejson.minzoom",
        "tilejson.maxzoom",
        F.get("tilejson.bounds", F.lit(0)).alias("minlon"),
        F.get("tilejson.bounds", F.lit(3)).alias("maxlat"),
        F.get("tilejson.center", F.lit(0)).alias("center_lon"),
        F.get("tilejson.center", F.lit(2)).alias("center_zoom"),
        F.array_join(named, ";").alias("layers"),
    )
