"""SQL fragments shared by the oracle queries."""

from __future__ import annotations


def case(column: str, table: dict, default: str = "null") -> str:
    """A CASE over the fixed values of a table."""

    def text(v) -> str:
        return str(v) if isinstance(v, int) else "'" + str(v) + "'"

    branches = " ".join(f"when {text(k)} then {text(v)}" for k, v in table.items())
    return f"case {column} {branches} else {default} end"


def tile_x(lon: str, side: str) -> str:
    return f"cast(floor(({lon}+180)/360e0*{side}) as bigint)"


def tile_y(lat: str, side: str) -> str:
    world = f"(1-ln(tan(radians({lat}))+1/cos(radians({lat})))/pi())/2e0"
    return f"cast(floor({world}*{side}) as bigint)"


def bounds(lon: str, lat: str, zoom: str, width: str, height: str) -> str:
    """minlon, minlat, maxlon, maxlat of a view."""
    wx = f"(({lon}+180)/360e0)"
    wy = f"((1-ln(tan(radians({lat}))+1/cos(radians({lat})))/pi())/2e0)"
    dx, dy = f"({width}/1024e0/power(2e0,{zoom}))", f"({height}/1024e0/power(2e0,{zoom}))"

    def to_lat(y: str) -> str:
        return f"degrees(atan(sinh(pi()*(1-2*({y})))))"

    return (
        f"({wx}-{dx})*360-180 as minlon, {to_lat(wy + '+' + dy)} as minlat, "
        f"({wx}+{dx})*360-180 as maxlon, {to_lat(wy + '-' + dy)} as maxlat"
    )


VIEW_BOUNDS = (
    "vb as (select *, "
    + bounds("center_lon", "center_lat", "zoom", "width_px", "height_px")
    + " from views)"
)

# Mean coordinates over integers of 1e-7 degrees.
CENTRE = """cast(sum(cast(round(lon*10000000) as bigint)) as bigint)/count(*)/10000000 as lon,
    cast(sum(cast(round(lat*10000000) as bigint)) as bigint)/count(*)/10000000 as lat"""

# Clusters of zooms 6..10: cells of the grid three levels deeper, centred on the mean.
PYRAMID = f"""
pyramid as (
  select zoom, cx, cy, {CENTRE}, count(*) as point_count
  from (select cast(z as int) as zoom, lon, lat,
          {tile_x('lon', 'power(2e0,z+3)')} as cx, {tile_y('lat', 'power(2e0,z+3)')} as cy
        from accidents, generate_series(6,10) as g(z))
  group by zoom, cx, cy)"""

# Visible count of each distinct view window.
WINDOW_COUNTS = """
boxes as (select distinct zoom, minlon, minlat, maxlon, maxlat from vb),
window_counts as (
  select b.zoom, b.minlon, b.minlat, b.maxlon, b.maxlat, cast(sum(p.point_count) as bigint) as n
  from boxes b join pyramid p on p.zoom=cast(floor(b.zoom) as int)
    and p.lon between b.minlon and b.maxlon and p.lat between b.minlat and b.maxlat
  where b.zoom<11 group by all
  union all
  select b.zoom, b.minlon, b.minlat, b.maxlon, b.maxlat, count(*) as n
  from boxes b join accidents a
    on a.lon between b.minlon and b.maxlon and a.lat between b.minlat and b.maxlat
  where b.zoom>=11 group by all)"""


def hilbert(source: str, z: str = "z", x: str = "x", y: str = "y") -> str:
    """CTEs ``walk`` and ``ids(z, x, y, tile_id)`` for the distinct tiles of a source.

    Walks the curve one bit at a time, turning the remaining square at each step.
    """
    return f"""
walk as (
  select {z} as z, {x} as x0, {y} as y0, cast({x} as bigint) as x, cast({y} as bigint) as y,
    cast(power(2,{z}) as bigint)//2 as n, cast(0 as bigint) as d
  from (select distinct {z}, {x}, {y} from {source} where {z} is not null)
  union all
  select z, x0, y0,
    case when y&n=0 and x&n>0 then n-1-(y&(n-1)) when y&n=0 then y&(n-1) else x&(n-1) end,
    case when y&n=0 and x&n>0 then n-1-(x&(n-1)) when y&n=0 then x&(n-1) else y&(n-1) end,
    n//2,
    d+n*n*case when x&n=0 and y&n=0 then 0 when x&n=0 then 1 when y&n>0 then 2 else 3 end
  from walk where n>0),
ids as (select z, x0 as x, y0 as y, (cast(power(4,z) as bigint)-1)//3+d as tile_id from walk where n=0)"""


def unhilbert(source: str, tid: str = "tile_id") -> str:
    """CTEs ``back`` and ``zxy(tile_id, z, x, y)`` for the distinct ids of a source."""
    return f"""
zoomed as (
  select tid, max(z) as z from (select distinct {tid} as tid from {source}), generate_series(0,26) as g(z)
  where (cast(power(4,z) as bigint)-1)//3<=tid group by tid),
back as (
  select tid, z, tid-(cast(power(4,z) as bigint)-1)//3 as t,
    cast(1 as bigint) as u, cast(0 as bigint) as x, cast(0 as bigint) as y
  from zoomed
  union all
  select tid, z, t//4, u*2,
    case t%4 when 0 then y when 1 then x when 2 then x+u else u-1-y+u end,
    case t%4 when 0 then x when 1 then y+u when 2 then y+u else u-1-x end
  from back where u<cast(power(2,z) as bigint)),
zxy as (select tid as tile_id, cast(z as int) as z, x, y from back where u=cast(power(2,z) as bigint))"""
