"""Queries on accident rows: filters, labels, colours, details, legend."""

from __future__ import annotations

from pyspark.sql import functions as F

from crashgrid import model
from crashgrid.functions import codes, geo, text
from crashgrid.operators import details, filters, layers
from crashgrid.model import FilterState
from crashgrid.plans.registry import query
from crashgrid.plans.sqltext import bounds, case

FLAGS = ["IstRad", "IstPKW", "IstFuss", "IstKrad", "IstGkfz", "IstSonstig"]


@query(
    "severe_soft_road_users",
    "accidents",
    sql="""select count(*) as n from accidents
where UKATEGORIE in (1,2) and UJAHR in (2021,2022,2023) and (IstRad=1 or IstFuss=1)""",
)
def severe_soft_road_users(load):
    state = FilterState(ukategorie=[1, 2], ujahr=[2021, 2022, 2023], flags=["IstRad", "IstFuss"])
    return filters.accident_filter(load("accidents"), state).agg(F.count("*").alias("n"))


@query(
    "accident_filter",
    "accidents",
    sql="""select OBJECTID, UKATEGORIE, UJAHR from accidents
where UKATEGORIE in (1,2,3) and UART in (0,1,2,3,4,5,6,7,8,9) and UTYP1 in (1,2,3,4,5,6,7)
  and UJAHR in (2017,2018,2019,2020,2021,2022,2023)
  and (IstRad=1 or IstPKW=1 or IstFuss=1 or IstKrad=1 or IstGkfz=1 or IstSonstig=1)""",
)
def accident_filter(load):
    kept = filters.accident_filter(load("accidents"), FilterState.all_checked())
    return kept.select("OBJECTID", "UKATEGORIE", "UJAHR")


FILTER_STATES = {
    "all": FilterState.all_checked(),
    "nothing": FilterState(),
    "years_only": FilterState(ujahr=[2020, 2021]),
    "no_years": FilterState(uart=[1, 5], utyp1=[2, 3]),
    "severity_only": FilterState(ukategorie=[1]),
    "flags_only": FilterState(flags=["IstGkfz", "IstKrad"]),
}


@query(
    "filter_rules",
    "accidents",
    sql="""
select count(*) filter (where UKATEGORIE in (1,2,3) and UART between 0 and 9 and UTYP1 between 1 and 7
    and UJAHR between 2017 and 2023
    and (IstRad=1 or IstPKW=1 or IstFuss=1 or IstKrad=1 or IstGkfz=1 or IstSonstig=1)) as "all",
  count(*) filter (where UKATEGORIE=-1) as nothing,
  count(*) filter (where UKATEGORIE=-1) as years_only,
  count(*) filter (where UART in (1,5) and UTYP1 in (2,3)) as no_years,
  count(*) filter (where UKATEGORIE=1) as severity_only,
  count(*) filter (where IstGkfz=1 or IstKrad=1) as flags_only
from accidents""",
)
def filter_rules(load):
    counts = [F.count_if(filters.accident_condition(s)).alias(n) for n, s in FILTER_STATES.items()]
    return load("accidents").agg(*counts)


def _sql_label(column: str, table: dict) -> str:
    text_ = f"cast({column} as varchar)"
    return f"coalesce({case(column, table)} || ' (' || {text_} || ')', {text_}, '?')"


@query(
    "code_labels",
    "accidents",
    sql=f"""select OBJECTID, {_sql_label('UKATEGORIE', model.SEVERITY_LABELS)} as severity,
  {_sql_label('UART', model.KIND_LABELS)} as kind, {_sql_label('UTYP1', model.TYPE_LABELS)} as type,
  coalesce(cast(UJAHR as varchar), '?') as year from accidents""",
)
def code_labels(load):
    return load("accidents").select(
        "OBJECTID",
        codes.code_label("UKATEGORIE", "UKATEGORIE").alias("severity"),
        codes.code_label("UART", "UART").alias("kind"),
        codes.code_label("UTYP1", "UTYP1").alias("type"),
        codes.code_label("UJAHR", "UJAHR").alias("year"),
    )


def _sql_join(table: dict) -> str:
    return "concat_ws(', ', " + ", ".join(f"case when {f}=1 then '{t}' end" for f, t in table.items()) + ")"


_SQL_DETAILS = " union all ".join(
    f"select OBJECTID, {i} as position, '{label}' as label, {value} as value from accidents"
    for i, (label, value) in enumerate(
        [
            ("Unfall-ID", "coalesce(cast(OBJECTID as varchar), '?')"),
            ("Schwere", _sql_label("UKATEGORIE", model.SEVERITY_LABELS)),
            ("Jahr", "coalesce(cast(UJAHR as varchar), '?')"),
            ("Unfallart", _sql_label("UART", model.KIND_LABELS)),
            ("Unfalltyp", _sql_label("UTYP1", model.TYPE_LABELS)),
            ("Beteiligung", f"nullif({_sql_join(model.PARTICIPANT_LABELS)}, '')"),
        ]
    )
)


@query("detail_rows", "accidents", sql=f"select * from ({_SQL_DETAILS}) where value is not null")
def detail_rows(load):
    return details.detail_rows(load("accidents"))


@query(
    "participant_texts",
    "accidents",
    sql=f"""select OBJECTID, {_sql_join(model.PARTICIPANT_LABELS)} as labels,
  {_sql_join(model.PARTICIPANT_LETTERS)} as letters, cast(null as varchar) as hidden from accidents""",
)
def participant_texts(load):
    return load("accidents").select(
        "OBJECTID",
        codes.participant_labels().alias("labels"),
        codes.participant_letters().alias("letters"),
        codes.participant_letters(show=False).alias("hidden"),
    )


_SQL_FIRST_FLAG = (
    "case " + " ".join(f"when {f}=1 then '{c}'" for f, c in model.PARTICIPANT_COLORS.items()) + " else '#aaaaaa' end"
)


@query(
    "category_colors",
    "accidents",
    sql=f"""select OBJECTID, {case('UKATEGORIE', model.SEVERITY_COLORS, "'#aaaaaa'")} as by_severity,
  {case('UJAHR', model.YEAR_COLORS, "'#aaaaaa'")} as by_year,
  {case('UART', model.KIND_COLORS, "'#aaaaaa'")} as by_kind,
  {case('UTYP1', model.TYPE_COLORS, "'#aaaaaa'")} as by_type,
  {_SQL_FIRST_FLAG} as by_participant from accidents""",
)
def category_colors(load):
    return load("accidents").select(
        "OBJECTID",
        codes.category_color("UKATEGORIE").alias("by_severity"),
        codes.category_color("UJAHR").alias("by_year"),
        codes.category_color("UART").alias("by_kind"),
        codes.category_color("UTYP1").alias("by_type"),
        codes.category_color("BETEILIGUNG").alias("by_participant"),
    )


_SQL_LEGEND = ", ".join(f"('{g}','{v}','{label}','{c}',{p})" for g, v, label, c, p in model.legend_rows())


@query(
    "legend_counts",
    "accidents",
    ctes=(
        f"legend(grp, val, label, color, position) as (values {_SQL_LEGEND})",
        """hits as (
  select 'UKATEGORIE' as grp, cast(UKATEGORIE as varchar) as val from accidents
  union all select 'UJAHR', cast(UJAHR as varchar) from accidents
  union all select 'UART', cast(UART as varchar) from accidents
  union all select 'UTYP1', cast(UTYP1 as varchar) from accidents """
        + " ".join(f"union all select 'BETEILIGUNG', '{f}' from accidents where {f}=1" for f in FLAGS)
        + ")",
    ),
    sql="""select l.grp, l.val, l.label, case when l.grp='UART' then l.color else '#ffffff' end as color,
  l.position, count(h.val) as accidents
from legend l left join hits h on h.grp=l.grp and h.val=l.val group by all""",
)
def legend_counts(load):
    return details.legend_counts(load("accidents"), "UART")


@query(
    "decode_codes",
    "accidents",
    sql=f"""select OBJECTID, {case('UKATEGORIE', model.SEVERITY_LABELS)} as "UKATEGORIE_label",
  {case('UART', model.KIND_LABELS)} as "UART_label", {case('UTYP1', model.TYPE_LABELS)} as "UTYP1_label",
  case when UJAHR between 2017 and 2023 then cast(UJAHR as varchar) end as "UJAHR_label",
  {case('UKATEGORIE', model.SEVERITY_COLORS, "'#aaaaaa'")} as "UKATEGORIE_color",
  {case('UART', model.KIND_COLORS, "'#aaaaaa'")} as "UART_color",
  {case('UTYP1', model.TYPE_COLORS, "'#aaaaaa'")} as "UTYP1_color",
  {case('UJAHR', model.YEAR_COLORS, "'#aaaaaa'")} as "UJAHR_color" from accidents""",
)
def decode_codes(load):
    groups = ["UKATEGORIE", "UART", "UTYP1", "UJAHR"]
    added = [f"{g}_{part}" for part in ("label", "color") for g in groups]
    return details.decode_codes(load("accidents")).select("OBJECTID", *added)


@query(
    "image_links",
    "images",
    sql="""select id, lon, lat, 'https://www.mapillary.com/app/?pKey=' || id || '&focus=photo' as link
from images where id<>''""",
)
def image_links(load):
    linked = load("images").withColumn("link", text.image_link(F.col("id")))
    return linked.where(F.col("link").isNotNull())


@query(
    "place_labels",
    "places",
    sql="""select place_id, coalesce(name,'') || ', ' || coalesce(nullif(city,''), nullif(country,''), '') as label
from places""",
)
def place_labels(load):
    label = text.place_label(F.col("name"), F.col("city"), F.col("country"))
    return load("places").select("place_id", label.alias("label"))


@query(
    "search_bbox",
    "places",
    sql="select place_id, lon, lat from places where lon between 5 and 15 and lat between 47 and 55",
)
def search_bbox(load):
    return filters.search_bbox(load("places")).select("place_id", "lon", "lat")


@query(
    "parse_codes",
    "searches toggles",
    ctes=("texts as (select q as t from searches union all select val from toggles union all select '-' || q from searches)",),
    sql=r"select t, try_cast(nullif(regexp_extract(t, '^\s*([+-]?\d+)', 1), '') as int) as code from texts",
)
def parse_codes(load):
    q = load("searches").select(F.col("q").alias("t"))
    minus = q.select(F.concat(F.lit("-"), "t").alias("t"))
    texts = q.unionByName(load("toggles").select(F.col("val").alias("t"))).unionByName(minus)
    return texts.select("t", text.parse_code(F.col("t")).alias("code"))


@query(
    "tile_code_names",
    sql=f"""select p_partkey, {case('p_size%7', model.TILE_TYPE_NAMES)} as type_name,
  {case('p_size%7', model.TILE_TYPE_EXTENSIONS, "''")} as ext, {case('p_size%7', model.TILE_TYPE_MIMES)} as mime,
  {case('p_size%7', model.COMPRESSION_NAMES)} as compression from part""",
)
def tile_code_names(load):
    code = F.col("p_size") % 7
    return load("part").select(
        "p_partkey",
        text.tile_type_name(code).alias("type_name"),
        text.tile_type_ext(code).alias("ext"),
        text.tile_type_mime(code).alias("mime"),
        text.compression_name(code).alias("compression"),
    )


_STARTS = [("z7", 7), ("z9", 9), ("z11", 11)]
_START_CTES = ", ".join(
    f"{n} as (select {bounds('13.634e0', '52.315e0', f'{z}e0', '1024', '768')})" for n, z in _STARTS
)


@query(
    "in_viewport_counts",
    "accidents",
    ctes=(_START_CTES,),
    sql="select "
    + ", ".join(
        f"count(*) filter (where lon between {n}.minlon and {n}.maxlon and lat between {n}.minlat and {n}.maxlat) as {n}"
        for n, _ in _STARTS
    )
    + " from accidents, z7, z9, z11",
)
def in_viewport_counts(load):
    counts = []
    for name, zoom in _STARTS:
        b = geo.viewport_bounds(F.lit(13.634), F.lit(52.315), F.lit(float(zoom)), 1024, 768)
        inside = filters.in_bounds(b["minlon"], b["minlat"], b["maxlon"], b["maxlat"])
        counts.append(F.count_if(inside).alias(name))
    return load("accidents").agg(*counts)


@query(
    "visible_layers",
    "views",
    ctes=(
        """registry(layer_id, source_layer, minzoom, maxzoom) as (values
  ('clusters-coarse-layer','clusters_6_8',6e0,9e0), ('clusters-fine-layer','clusters_9_11',9e0,11e0),
  ('accident-points-11-12','accidents',11e0,12e0), ('accident-points-12-13','accidents',12e0,20.1e0),
  ('mapillary-images-layer','image',14e0,1e9)),
  seen as (select view_id, case when view_id%37=0 then 14.99e0 else zoom end as zoom from views)""",
    ),
    sql="""select view_id, zoom, layer_id, source_layer from seen join registry
on zoom>=minzoom and zoom<maxzoom""",
)
def visible_layers(load):
    # Image mode holds the view at 14.99.
    zoom = F.when(F.col("view_id") % 37 == 0, 14.99).otherwise(F.col("zoom"))
    views = load("views").withColumn("zoom", zoom)
    shown = layers.visible_layers(views, toggles={"mapillary-images-layer": True})
    return shown.select("view_id", "zoom", "layer_id", "source_layer")


@query(
    "point_layer_union",
    "accidents",
    sql="""select 'accident-points-11-12' as layer, UJAHR, count(*) as n from accidents where UJAHR<2020 group by all
union all select 'accident-points-12-13', UJAHR, count(*) from accidents where UJAHR>=2019 group by all""",
)
def point_layer_union(load):
    df = load("accidents")
    a = df.where(F.col("UJAHR") < 2020).withColumn("layer", F.lit("accident-points-11-12"))
    b = df.where(F.col("UJAHR") >= 2019).withColumn("layer", F.lit("accident-points-12-13"))
    return layers.union_layers(a, b).groupBy("layer", "UJAHR").agg(F.count("*").alias("n"))


@query(
    "layer_fields",
    "accidents",
    ctes=(
        "named as (select case when UART is null then 'no_kind' when IstGkfz is null then 'no_truck' else 'full' end as layer, * from accidents)",
        "attrs as ("
        + " union all ".join(
            f"select distinct layer, '{c}' as a from named where {c} is not null"
            for c in ["OBJECTID", "lon", "lat", "UKATEGORIE", "UJAHR", "UART", "UTYP1", *FLAGS]
        )
        + ")",
    ),
    sql="select layer, string_agg(a, ',' order by a) as fields from attrs group by layer",
)
def layer_fields(load):
    layer = (
        F.when(F.col("UART").isNull(), F.lit("no_kind"))
        .when(F.col("IstGkfz").isNull(), F.lit("no_truck"))
        .otherwise(F.lit("full"))
    )
    fields = layers.layer_fields(load("accidents").withColumn("layer", layer))
    return fields.select("layer", F.array_join("fields", ",").alias("fields"))
