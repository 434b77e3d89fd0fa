"""Test inputs derived from the driver's tables.

Every block is one SQL text that runs unchanged in Spark and in DuckDB; see
FIXTURES.md. Table names stand in braces, so Spark binds them to DataFrames and
the oracle to the views of the same name. No block drops rows of its table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "accidents": """
with b as (
  select ((l_orderkey*32768+l_partkey)*2048+l_suppkey)*8+l_linenumber as objectid,
         l_suppkey, l_partkey, l_linenumber, l_shipdate,
         (l_orderkey*7919+l_partkey*104729+l_linenumber*31)%1000003 as h1,
         (l_orderkey*15485863+l_partkey*611953+l_suppkey*97+l_linenumber*17)%1000003 as h2
  from {lineitem})
select objectid as OBJECTID,
  5.9e0+((l_suppkey*7919+13)%9100)/1000e0+((h1%2001)-1000)/10000e0 as lon,
  47.3e0+((l_suppkey*104729+7)%7700)/1000e0+((h2%2001)-1000)/10000e0 as lat,
  cast(case when h1%100=0 then 1 when h1%100<20 then 2 else 3 end as int) as UKATEGORIE,
  cast(year(l_shipdate)+22 as int) as UJAHR,
  cast(case when h1%97=0 then null when h1%89=0 then 42 else l_partkey%10 end as int) as UART,
  cast(case when h2%101=0 then null else 1+(l_partkey*3+l_linenumber)%7 end as int) as UTYP1,
  cast(case when h1%3=0 then 1 else 0 end as int) as IstRad,
  cast(case when h2%4<3 then 1 else 0 end as int) as IstPKW,
  cast(case when h1%7=0 then 1 else 0 end as int) as IstFuss,
  cast(case when h2%11=0 then 1 else 0 end as int) as IstKrad,
  cast(case when h1%1009=0 then null when h2%13=0 then 1 else 0 end as int) as IstGkfz,
  cast(case when h1%17=0 then 1 else 0 end as int) as IstSonstig
from b""",
    "places": """
select s_suppkey as place_id, s_name as name,
  case when s_suppkey%5=0 then null when s_suppkey%5=1 then '' else n_name end as city,
  case when s_suppkey%7=0 then null else r_name end as country,
  5.9e0+((s_suppkey*7919+13)%9100)/1000e0 as lon,
  47.3e0+((s_suppkey*104729+7)%7700)/1000e0 as lat
from {supplier} join {nation} on s_nationkey=n_nationkey join {region} on n_regionkey=r_regionkey""",
    "views": """
with c as (
  select event_id, user_id, ts, case when event_id%3=0 then 1 else event_id%1000 end as centre
  from {events})
select event_id as view_id, case when event_id%11=0 then -1-user_id else user_id end as session_id, ts,
  5.9e0+((centre*7919+13)%9100)/1000e0 as center_lon,
  47.3e0+((centre*104729+7)%7700)/1000e0 as center_lat,
  6e0+(event_id%19)/2e0 as zoom, 1000 as width_px, 768 as height_px
from c""",
    "cursors": """
with c as (
  select event_id, case when event_id%3=0 then 1 else event_id%1000 end as centre from {events})
select event_id as cursor_id,
  5.9e0+((centre*7919+13)%9100)/1000e0+((event_id*37)%1201-600)/10007e0 as lon,
  47.3e0+((centre*104729+7)%7700)/1000e0+((event_id*53)%1201-600)/10007e0 as lat,
  11e0+(event_id%14)/4e0 as zoom
from c""",
    "keystrokes": """
select user_id, event_id, ts, substr(event_type,1,cast(event_id%7 as int)) as q from {events}""",
    "searches": """
select event_id as search_id, user_id, ts,
  case event_id%4
    when 0 then substr(event_type,1,cast(event_id%7 as int))
    when 1 then substr('SUPPLIER#0000',1,cast(1+event_id%13 as int))
    when 2 then concat('0', cast(event_id%500 as string))
    else concat('Supplier#', lpad(cast(1+event_id%1200 as string),9,'0')) end as q
from {events}""",
    "toggles": """
select user_id as session_id, event_id, ts,
  case event_id%5 when 0 then 'UKATEGORIE' when 1 then 'UART' when 2 then 'UTYP1' when 3 then 'UJAHR' else 'BETEILIGUNG' end as grp,
  case event_id%5 when 0 then cast(1+event_id%3 as string) when 1 then cast(event_id%7 as string)
    when 2 then cast(1+event_id%7 as string) when 3 then cast(2017+event_id%7 as string)
    else case event_id%6 when 0 then 'IstRad' when 1 then 'IstPKW' when 2 then 'IstFuss' when 3 then 'IstKrad' when 4 then 'IstGkfz' else 'IstSonstig' end end as val,
  event_id%4<>0 as checked
from {events}""",
    "tile_entries": """
select 1398101+p_partkey*7 as tile_id, 1+p_partkey%6 as run_length, p_partkey*1000 as data_offset, cast(200+p_size as bigint) as data_length from {part}""",
    "tile_requests": """
select event_id as request_id, 1398101+(event_id*37)%7000 as tile_id from {events}""",
    "tile_contents": """
select 1398101+p_partkey+cast(floor(p_partkey/31e0) as bigint) as tile_id, cast(floor(p_partkey/7e0) as bigint)%5 as content from {part}""",
    "tile_urls": """
select event_id as request_id,
  case when event_id%50=0 then 'http://x' else concat('pmtiles://tiles/accidents.pmtiles/', cast(event_id%12 as string), '/',
    cast((event_id*31)%cast(power(2,event_id%12) as bigint) as string), '/', cast((event_id*17)%cast(power(2,event_id%12) as bigint) as string)) end as url
from {events}""",
    "images": """
select case when page_id%9=0 then null when page_id%10=0 then '' else cast(page_id as string) end as id,
  5.9e0+((page_id*7919+13)%9100)/1000e0 as lon, 47.3e0+((page_id*104729+7)%7700)/1000e0 as lat
from {pages}""",
}


def tables_of(name: str) -> list[str]:
    """Names of the driver tables one block reads."""
    return sorted(set(re.findall(r"\{(\w+)\}", SQL[name])))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived input as a DataFrame."""
    sources = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(name)}
    return spark.sql(SQL[name], **sources)


def cte(name: str) -> str:
    """One derived input as a CTE for the oracle."""
    body = re.sub(r"\{(\w+)\}", r"\1", SQL[name]).strip()
    return f"{name} as (\n{body}\n)"
