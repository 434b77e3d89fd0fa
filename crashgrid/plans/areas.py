"""Queries on clusters, views, cursors and places near accidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from crashgrid import model
from crashgrid.functions import curve, geo, sizing
from crashgrid.model import FilterState
from crashgrid.operators import clusters as cl
from crashgrid.operators import layers, search, sessions, viewport
from crashgrid.operators.filters import accident_boxes, accident_filter, boxes_match
from crashgrid.operators.pick import pick as pick_accidents
from crashgrid.plans.registry import query
from crashgrid.plans.sqltext import CENTRE, PYRAMID, VIEW_BOUNDS, WINDOW_COUNTS, bounds, tile_x, tile_y
from crashgrid.sources import increments, pyramid, scans, storage


def _sql_radius(n: str, stops: list[tuple[int, int]]) -> str:
    parts = [f"when {n}<={stops[0][0]} then {stops[0][1]}e0"]
    for (n0, r0), (n1, r1) in zip(stops, stops[1:]):
        parts.append(f"when {n}<={n1} then {r0}e0+({n}-{n0})*{r1 - r0}e0/{n1 - n0}")
    return "case " + " ".join(parts) + f" else {stops[-1][1]}e0 end"


_SQL_FINE = _sql_radius("point_count", [(1, 2), (10, 4), (50, 6), (100, 8), (200, 10), (500, 12), (1000, 14), (2000, 18), (4000, 22)])
_SQL_COARSE = _sql_radius(
    "point_count",
    [(1, 2), (10, 4), (50, 6), (100, 8), (200, 10), (500, 12), (1000, 14), (2000, 18), (4000, 22), (8000, 24), (16000, 26)],
)


def _sql_class(index: int) -> str:
    rows = [(lo, label, px) for lo, label, px in reversed(model.SIZE_CLASSES)]
    value = (lambda r: f"'{r[1]}'") if index == 1 else (lambda r: str(r[2]))
    return "case " + " ".join(f"when point_count>={r[0]} then {value(r)}" for r in rows) + " end"


@query(
    "cluster_points",
    "accidents",
    sql=f"""select 9 as zoom, cx, cy, {CENTRE}, count(*) as point_count
from (select lon, lat, {tile_x('lon', '4096')} as cx, {tile_y('lat', '4096')} as cy from accidents) group by cx, cy""",
)
def cluster_points(load):
    return cl.cluster_points(load("accidents"), 9).select("zoom", "cx", "cy", "lon", "lat", "point_count")


@query(
    "cluster_pyramid",
    "accidents",
    ctes=(PYRAMID,),
    sql="select zoom, cx, cy, lon, lat, point_count from pyramid",
)
def cluster_pyramid(load):
    return cl.cluster_pyramid(load("accidents")).select("zoom", "cx", "cy", "lon", "lat", "point_count")


@query(
    "cluster_symbols",
    "accidents",
    ctes=(PYRAMID,),
    sql=f"""select zoom, cx, cy, point_count, round({_SQL_FINE},6) as fine_radius,
  round({_SQL_COARSE},6) as coarse_radius, {_sql_class(1)} as size_label, {_sql_class(2)} as dot_px,
  case when point_count<>0 then point_count || ' Unfälle' end as tooltip from pyramid""",
)
def cluster_symbols(load):
    n = F.col("point_count")
    size = sizing.cluster_size_class(n)
    return cl.cluster_pyramid(load("accidents")).select(
        "zoom",
        "cx",
        "cy",
        "point_count",
        F.round(sizing.cluster_radius(n, "fine"), 6).alias("fine_radius"),
        F.round(sizing.cluster_radius(n, "coarse"), 6).alias("coarse_radius"),
        size["label"].alias("size_label"),
        size["dot_px"].alias("dot_px"),
        sizing.cluster_tooltip(n).alias("tooltip"),
    )


def flagship(accidents):
    """Severe accidents of pedestrians and cyclists as clusters of zoom 9, largest on top."""
    state = FilterState(ukategorie=[1, 2], ujahr=[2021, 2022, 2023], flags=["IstRad", "IstFuss"])
    clusters = cl.cluster_points(accident_filter(accidents, state), 9)
    n = F.col("point_count")
    return cl.draw_order(clusters).select(
        "cx",
        "cy",
        "lon", "lat",
        "point_count",
        F.round(sizing.cluster_radius(n), 6).alias("radius"),
        sizing.cluster_size_class(n)["label"].alias("size_label"),
    )


@query(
    "flagship",
    "accidents",
    sql=f"""select cx, cy, lon, lat, point_count, round({_SQL_FINE},6) as radius,
  {_sql_class(1)} as size_label
from (select cx, cy, {CENTRE}, count(*) as point_count
  from (select lon, lat, {tile_x('lon', '4096')} as cx, {tile_y('lat', '4096')} as cy from accidents
    where UKATEGORIE in (1,2) and UJAHR in (2021,2022,2023) and (IstRad=1 or IstFuss=1)) group by cx, cy)
order by point_count, cx, cy""",
)
def flagship_query(load):
    return flagship(load("accidents"))


@query(
    "visible_points",
    "accidents",
    ctes=(f"b as (select {bounds('13.634e0', '52.315e0', '7e0', '1024', '768')})",),
    sql="""select count(*) as visible from accidents, b
where lon between minlon and maxlon and lat between minlat and maxlat and UKATEGORIE in (1,2) and IstPKW=1""",
)
def visible_points(load):
    b = geo.viewport_bounds(F.lit(13.634), F.lit(52.315), F.lit(7.0), 1024, 768)
    state = FilterState(ukategorie=[1, 2], flags=["IstPKW"])
    return viewport.visible_points(load("accidents"), tuple(b[s] for s in viewport.BOX[1:]), state)


@query(
    "visible_cluster_total",
    "accidents",
    ctes=(PYRAMID, f"b as (select {bounds('13.634e0', '52.315e0', '7e0', '1024', '768')})"),
    sql="""select cast(coalesce(sum(case when cx%5<>0 then point_count end),0) as bigint) as total from pyramid, b
where zoom=7 and lon between minlon and maxlon and lat between minlat and maxlat""",
)
def visible_cluster_total(load):
    """Both cluster layers are asked, but only the one of the view's zoom is drawn."""
    zoom = F.lit(7.0)
    every = cl.cluster_pyramid(load("accidents"), zooms=(7, 9))
    # Some clusters come without a count.
    every = every.withColumn("point_count", F.when(F.col("cx") % 5 != 0, F.col("point_count")))
    coarse = every.where(F.col("zoom") == 7).withColumn("layer", F.lit(model.COARSE_LAYER))
    fine = every.where(F.col("zoom") == 9).withColumn("layer", F.lit(model.FINE_LAYER))
    drawn = layers.union_layers(coarse, fine).where(F.col("layer") == cl.cluster_layer(zoom))
    b = geo.viewport_bounds(F.lit(13.634), F.lit(52.315), zoom, 1024, 768)
    inside = F.col("lon").between(b["minlon"], b["maxlon"]) & F.col("lat").between(b["minlat"], b["maxlat"])
    return cl.visible_cluster_total(drawn, inside)


@query(
    "viewport_bounds",
    "views",
    ctes=(VIEW_BOUNDS,),
    sql="""select view_id, round(minlon,6) as minlon, round(minlat,6) as minlat, round(maxlon,6) as maxlon,
  round(maxlat,6) as maxlat, least(greatest(zoom,6e0),20e0) as view_zoom, least(greatest(zoom,14e0),14.99e0) as image_zoom from vb""",
)
def viewport_bounds(load):
    placed = viewport.with_bounds(load("views"))
    return placed.select(
        "view_id",
        *[F.round(c, 6).alias(c) for c in viewport.BOX[1:]],
        geo.clamp_zoom(F.col("zoom")).alias("view_zoom"),
        geo.clamp_zoom(F.col("zoom"), *model.IMAGE_ZOOM_RANGE).alias("image_zoom"),
    )


_SQL_CAPTION = """'Sichtbare Punkte' || case when zoom<11 then ' (Cluster)' else '' end || ': '
  || format('{:,}', coalesce(n,0)) || chr(10) || 'Zoomlevel: ' || format('{:.2f}', zoom)"""


@query(
    "view_counts",
    "accidents views",
    ctes=(VIEW_BOUNDS, PYRAMID, WINDOW_COUNTS),
    sql=f"""select view_id, v.zoom, v.zoom<11 as clustered, coalesce(n,0) as visible, {_SQL_CAPTION.replace('zoom', 'v.zoom')} as caption
from vb v left join window_counts c on c.zoom=v.zoom and c.minlon=v.minlon and c.minlat=v.minlat
  and c.maxlon=v.maxlon and c.maxlat=v.maxlat""",
)
def view_counts(load):
    counted = viewport.view_counts(load("views"), load("accidents"))
    caption = sizing.count_caption(F.col("visible"), F.col("zoom"), F.col("clustered"))
    return counted.select("view_id", "zoom", "clustered", "visible", caption.alias("caption"))


_FIELDS = [("ukategorie", "UKATEGORIE"), ("uart", "UART"), ("utyp1", "UTYP1"), ("ujahr", "UJAHR")]
_LAST_TOGGLES = """
boxes as (select session_id, grp, val, max_by(checked, struct_pack(a:=ts, b:=event_id)) as checked from toggles group by all),
defaults(grp, val) as (values """ + ", ".join(
    f"('{g}','{v}')" for g, v, *_ in model.legend_rows()
) + """),
chosen as (
  select s.session_id, d.grp, d.val from (select distinct session_id from boxes) s cross join defaults d
  left join boxes b on b.session_id=s.session_id and b.grp=d.grp and b.val=d.val
  where coalesce(b.checked, true)),
state as (
  select session_id, """ + ", ".join(
    f"coalesce(list(cast(case when grp<>'BETEILIGUNG' then val end as int)) filter (where grp='{c}'), []) as {n}" for n, c in _FIELDS
) + """, coalesce(list(val) filter (where grp='BETEILIGUNG'), []) as flags from chosen group by session_id)"""


def _sql_texts() -> str:
    parts = [f"array_to_string(list_sort({n}), ',') as {n}" for n, _ in _FIELDS]
    return ", ".join([*parts, "array_to_string(list_sort(flags), ',') as flags"])


@query(
    "selection_state",
    "toggles",
    ctes=(_LAST_TOGGLES,),
    sql=f"select session_id, {_sql_texts()} from state",
)
def selection_state(load):
    return selection_texts(sessions.selection_state(load("toggles")))


def selection_texts(states):
    """Selection lists as sorted comma-joined texts."""
    lists = states.select("session_id", sessions.selection_lists(F.col("mask")).alias("s"))
    texts = [F.array_join(F.array_sort(f"s.{n}"), ",").alias(n) for n in sessions.STATE_FIELDS]
    return lists.select("session_id", *texts)


@query(
    "viewport_join",
    "accidents views toggles",
    ctes=(
        VIEW_BOUNDS,
        _LAST_TOGGLES.replace(
            "select distinct session_id from boxes", "select session_id from boxes union select session_id from views"
        ),
        """strips as (
  select *, unnest(generate_series(cast(floor(minlon*5) as bigint), cast(floor(maxlon*5) as bigint))) as strip
  from vb where zoom>=11)""",
    ),
    sql="""select v.view_id, a.OBJECTID, a.UKATEGORIE
from strips v join state s on s.session_id=v.session_id
join accidents a on cast(floor(a.lon*5) as bigint)=v.strip
  and a.lon between v.minlon and v.maxlon and a.lat between v.minlat and v.maxlat
where len(s.ukategorie)+len(s.uart)+len(s.utyp1)+len(flags)>0
  and (len(s.ukategorie)=0 or list_contains(s.ukategorie, a.UKATEGORIE)) and (len(s.uart)=0 or list_contains(s.uart, a.UART))
  and (len(s.utyp1)=0 or list_contains(s.utyp1, a.UTYP1)) and (len(s.ujahr)=0 or list_contains(s.ujahr, a.UJAHR))
  and (len(flags)=0 """
    + " ".join(f"or (list_contains(flags,'{f}') and a.{f}=1)" for f in model.PARTICIPANTS)
    + ")",
)
def viewport_join(load):
    views = sessions.with_state(load("views"), sessions.selection_state(load("toggles"))).drop("session_id", "ts")
    accidents = load("accidents").select(
        "OBJECTID", "UKATEGORIE", "lon", "lat", accident_boxes().alias("boxes")
    )
    matching = boxes_match(F.col("mask"), F.col("boxes"))
    pairs = viewport.viewport_join(views, accidents, matching, by=["mask"], keep=["view_id"])
    return pairs.select("view_id", "OBJECTID", "UKATEGORIE")


_WX, _WY = "(({0}+180)/360e0)", "((1-ln(tan(radians({0}))+1/cos(radians({0})))/pi())/2e0)"


@query(
    "pick_accident",
    "accidents cursors",
    ctes=(
        f"cb as (select *, {bounds('lon', 'lat', 'zoom', '13', '13')} from cursors)",
        f"""near as (
  select c.cursor_id, a.OBJECTID, sqrt(power({_WX.format('a.lon')}-{_WX.format('c.lon')},2)
    +power({_WY.format('a.lat')}-{_WY.format('c.lat')},2))*512*power(2e0,c.zoom) as d
  from cb c join accidents a on a.lon between c.minlon and c.maxlon and a.lat between c.minlat and c.maxlat)""",
    ),
    sql="""select cursor_id, OBJECTID, round(d,6) as distance_px from near where d<=6.5
qualify row_number() over (partition by cursor_id order by d, OBJECTID)=1""",
)
def pick(load):
    hits = pick_accidents(load("cursors"), load("accidents"))
    return hits.select("cursor_id", "OBJECTID", F.round("distance_px", 6).alias("distance_px"))


_HITS = """
asked as (select search_id, ts, user_id, lower(trim(q)) as t from searches where lower(trim(q))<>''),
texts as (select distinct t from asked),
ranked as (
  select t, p.*, row_number() over (partition by t order by
    case when lower(trim(name))=t then 0 when starts_with(lower(trim(name)), t) then 1 else 2 end, name, place_id) as position
  from texts join places p on contains(lower(trim(p.name)), t) and lon between 5 and 15 and lat between 47 and 55),
hits as (
  select search_id, cast(position as int) as position, place_id, lon, lat,
    coalesce(name,'') || ', ' || coalesce(nullif(city,''), nullif(country,''), '') as label
  from asked join ranked using (t) where position<=5)"""


@query(
    "geocode",
    "searches places",
    ctes=(_HITS,),
    sql="select search_id, position, place_id, label from hits",
)
def geocode(load):
    hits = search.geocode(load("searches"), load("places"))
    return hits.select("search_id", "position", "place_id", "label")


@query(
    "first_hit",
    "searches places",
    ctes=(_HITS,),
    sql="select search_id, place_id, label, lon, lat from hits where position=1",
)
def first_hit(load):
    hits = search.first_hit(load("searches"), load("places"))
    return hits.select("search_id", "place_id", "label", "lon", "lat")


@query(
    "accidents_near_place",
    "accidents searches places",
    ctes=(
        _HITS,
        f"spots as (select distinct place_id, {bounds('lon', 'lat', '15e0', '1024', '768')} from hits where position=1)",
        """near as (
  select s.place_id, count(*) as n from spots s join accidents a
    on a.lon between minlon and maxlon and a.lat between minlat and maxlat group by s.place_id)""",
    ),
    sql="""select search_id, place_id, coalesce(n,0) as visible from hits left join near using (place_id)
where position=1""",
)
def accidents_near_place(load):
    hits = search.first_hit(load("searches"), load("places"))
    near = viewport.accidents_near_place(hits, load("accidents"))
    return near.select("search_id", "place_id", "visible")


@query(
    "layer_store",
    "accidents",
    ctes=(PYRAMID,),
    sql=f"""select 'accidents' as layer, 12 as zoom, x, y, count(*) as n from
  (select {tile_x('lon', '4096')} as x, {tile_y('lat', '4096')} as y from accidents) group by x, y
union all
select case when zoom<9 then 'clusters_6_8' else 'clusters_9_11' end, zoom,
  {tile_x('lon', 'power(2e0,zoom)')} as x, {tile_y('lat', 'power(2e0,zoom)')} as y,
  cast(sum(point_count) as bigint) from pyramid group by all""",
)
def layer_store(load):
    """Write the layers, read them back and count what each tile holds."""
    accidents = load("accidents")
    spark = accidents.sparkSession
    path = storage.new_path(spark, "layers")
    pyramid.write_pyramid(accidents, path)
    points = scans.read_layer(spark, path, pyramid.POINT_LAYER)
    clusters = [scans.read_layer(spark, path, name) for name in (model.COARSE_LAYER, model.FINE_LAYER)]
    counts = layers.union_layers(
        points.select("layer", "zoom", "tile_id", F.lit(1).cast("bigint").alias("n")),
        *[c.select("layer", "zoom", "tile_id", F.col("point_count").alias("n")) for c in clusters],
    )
    totals = counts.groupBy("layer", "zoom", "tile_id").agg(F.sum("n").alias("n"))
    return curve.with_tile_zxy(totals).select("layer", "zoom", "x", "y", "n")


LAST_YEAR = 2023


def _grown_store(load):
    """A store of all years but the last one, to which that year is added."""
    accidents = load("accidents")
    path = storage.new_path(accidents.sparkSession, "grown")
    is_last = F.coalesce(F.col("UJAHR") == LAST_YEAR, F.lit(False))
    increments.add(accidents.where(~is_last), path)
    increments.add(accidents.where(is_last), path)
    return accidents.sparkSession, path


@query(
    "pyramid_increment",
    "accidents",
    ctes=(PYRAMID,),
    sql="select zoom, cx, cy, lon, lat, point_count from pyramid",
)
def pyramid_increment(load):
    """Clusters after a year was added equal those built from all years at once."""
    spark, path = _grown_store(load)
    return increments.read_clusters(spark, path)


@query(
    "layer_bands",
    "accidents",
    ctes=(PYRAMID,),
    sql=f"""select 'accidents_11-12' as layer, 11 as zoom, x, y, count(*) as n from
  (select {tile_x('lon', '2048')} as x, {tile_y('lat', '2048')} as y from accidents) group by x, y
union all
select 'accidents_12-13', 12, x, y, count(*) from
  (select {tile_x('lon', '4096')} as x, {tile_y('lat', '4096')} as y from accidents) group by x, y
union all
select case when zoom<9 then 'clusters_6_8' else 'clusters_9_11' end, zoom,
  {tile_x('lon', 'power(2e0,zoom)')} as x, {tile_y('lat', 'power(2e0,zoom)')} as y,
  cast(sum(point_count) as bigint) from pyramid group by all""",
)
def layer_bands(load):
    """What each tile of the four layers holds, both point bands and both cluster layers."""
    spark, path = _grown_store(load)
    bands = [increments.read_points(spark, path, name) for name, _ in model.POINT_BANDS]
    points = [b.groupBy("layer", "zoom", "tile_id").agg(F.count("*").alias("n")) for b in bands]
    clusters = increments.read_clusters(spark, path).withColumns(
        {
            "layer": cl.cluster_layer(F.col("zoom")),
            "x": geo.tile_x(F.col("lon"), F.col("zoom")),
            "y": geo.tile_y(F.col("lat"), F.col("zoom")),
        }
    )
    per_tile = clusters.groupBy("layer", "zoom", "x", "y").agg(F.sum("point_count").alias("n"))
    placed = curve.with_tile_zxy(layers.union_layers(*points)).select("layer", "zoom", "x", "y", "n")
    return layers.union_layers(placed, per_tile)


@query(
    "layer_order",
    "accidents",
    sql="""select layer, cast(case when UJAHR=2023 then 1 else 0 end as int) as version, count(*) as "rows",
  cast(0 as bigint) as inversions, cast(0 as bigint) as overlaps
from accidents, (values ('accidents_11-12'), ('accidents_12-13')) as b(layer) group by all""",
)
def layer_order(load):
    """Stored points are sorted by tile id, within files and from file to file."""
    spark, path = _grown_store(load)
    bands = [increments.read_points(spark, path, name) for name, _ in model.POINT_BANDS]
    return layers.union_layers(*[increments.order_of(band) for band in bands])
