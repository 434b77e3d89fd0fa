"""Queries on user events, as batch jobs and as streams run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from crashgrid.operators import sessions
from crashgrid.plans import areas
from crashgrid.plans.registry import query, stream_query
from crashgrid.plans.sqltext import PYRAMID, VIEW_BOUNDS, WINDOW_COUNTS
from crashgrid.sources import storage
from crashgrid.streaming import events, folds

# The events of the given table lie hours apart, so bursts are judged with a wide gap.
GAP = "6 hours"
GAP_SECONDS = 6 * 3600.0
DELAY = "1 hour"


def _wall_micros(ts: str):
    """Microseconds of the wall-clock time, whatever the session time zone."""
    epoch = "timestamp_ntz'1970-01-01 00:00:00'"
    micros = f"timestampdiff(MICROSECOND, {epoch}, cast({ts} as timestamp_ntz))"
    return F.expr(micros).alias("fired_us")


_FIRED = """
followed as (
  select *, lead(ts) over (partition by user_id order by ts, event_id) as next_ts from keystrokes),
fired as (
  select user_id, ts + interval 6 hour as fired_at, q from followed
  where (next_ts is null or next_ts-ts > interval 6 hour) and length(q)>=2)"""


@query(
    "debounce",
    "keystrokes",
    ctes=(_FIRED,),
    sql="select user_id, epoch_us(fired_at) as fired_us, q from fired",
)
def debounce(load):
    fired = sessions.debounce(load("keystrokes"), gap_seconds=GAP_SECONDS)
    return fired.select("user_id", _wall_micros("fired_at"), "q")


@stream_query(
    "debounce_stream",
    "keystrokes",
    ctes=(_FIRED,),
    sql="""select user_id, epoch_us(fired_at) as fired_us, q from fired
where fired_at <= (select max(ts) - interval 1 hour from keystrokes)""",
)
def debounce_stream(spark, stream, load):
    """Bursts still open at the last watermark stay in the state and are not emitted."""
    fired = events.debounce_stream(stream("keystrokes"), gap=GAP, delay=DELAY)
    path = storage.new_path(spark, "debounce")
    events.append_to(fired, path, storage.new_path(spark, "debounce-state")).awaitTermination()
    written = spark.read.schema(fired.schema).parquet(path)
    return written.select("user_id", _wall_micros("fired_at"), "q")


@stream_query(
    "debounce_stream_closed",
    "keystrokes",
    ctes=(_FIRED,),
    sql="select user_id, epoch_us(fired_at) as fired_us, q from fired",
)
def debounce_stream_closed(spark, stream, load):
    """All bursts, also those open at the end of the input: the rows of the batch operator."""
    keystrokes = stream("keystrokes")
    path = storage.new_path(spark, "bursts")
    folds.debounce_fold(keystrokes, path, storage.new_path(spark, "bursts-state"), gap=GAP, delay=DELAY).awaitTermination()
    folds.close_bursts(spark, path, keystrokes, gap=GAP)
    fired = spark.read.parquet(f"{path}/fired")
    return fired.select("user_id", _wall_micros("fired_at"), "q")


# Keystrokes reach the server by day of their time, every tenth three days later.
_ARRIVALS = """
sent as (
  select *, date_diff('day', timestamp '2024-01-01', ts) + case when event_id%10=0 then 3 else 0 end as day from keystrokes),
dealt as (
  select *, cast(floor((day - min(day) over ()) * 4 / (1 + max(day) over () - min(day) over ())) as int) as batch from sent),
latest as (select batch, max(ts) as t from dealt group by batch),
marks as (select b.batch, max(l.t) - interval 1 hour as watermark from latest b left join latest l on l.batch<b.batch group by b.batch),
judged as (select d.*, coalesce(d.ts < watermark, false) as late from dealt d join marks using (batch)),
followed as (
  select *, lead(ts) over (partition by user_id order by ts, event_id) as next_ts from judged where not late),
fired as (
  select event_id, user_id, ts, q from followed
  where (next_ts is null or next_ts-ts > interval 6 hour) and length(q)>=2)"""


@query(
    "debounce_stream_late",
    "keystrokes",
    ctes=(_ARRIVALS,),
    sql="""select 'late' as kind, user_id, epoch_us(ts) as us, q from judged where late
union all select 'fired', user_id, epoch_us(ts + interval 6 hour), q from fired""",
)
def debounce_stream_late(load):
    """Four batches in which some rows come after the watermark: they are kept apart, not dropped."""
    keystrokes = load("keystrokes")
    spark = keystrokes.sparkSession
    day = F.expr("datediff(ts, timestamp_ntz'2024-01-01 00:00:00') + if(event_id % 10 = 0, 3, 0)")
    sent = keystrokes.withColumn("day", day)
    span = sent.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    dealt = sent.withColumn("batch", F.floor((F.col("day") - span.first) * 4 / (1 + span.last - span.first)))
    source = storage.new_path(spark, "arrivals")
    path, state = storage.new_path(spark, "bursts"), storage.new_path(spark, "bursts-state")
    for number in range(4):
        # One file after the other, each one a batch.
        dealt.where(F.col("batch") == number).drop("day", "batch").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(keystrokes.schema).parquet(source)
        folds.debounce_fold(stream, path, state, gap=GAP, delay=DELAY).awaitTermination()
    folds.close_bursts(spark, path, keystrokes, gap=GAP)
    late, fired = spark.read.parquet(f"{path}/late"), spark.read.parquet(f"{path}/fired")
    return late.select(F.lit("late").alias("kind"), "user_id", _wall_micros("ts").alias("us"), "q").unionByName(
        fired.select(F.lit("fired").alias("kind"), "user_id", _wall_micros("fired_at").alias("us"), "q")
    )


@stream_query(
    "selection_stream",
    "toggles",
    ctes=(areas._LAST_TOGGLES,),
    sql=f"select session_id, {areas._sql_texts()} from state",
)
def selection_stream(spark, stream, load):
    """Selections of live sessions; the sessions that ended before are in a table of their own."""
    toggles = stream("toggles")
    path = storage.new_path(spark, "toggles")
    folds.selection_fold(toggles, path, storage.new_path(spark, "toggles-state"), idle="10000 days").awaitTermination()
    schema = "session_id bigint, grp string, val string, ts timestamp, event_id bigint, checked boolean"
    return areas.selection_texts(folds.selection_now(spark, path, schema))


@stream_query(
    "view_count_stream",
    "accidents views",
    ctes=(VIEW_BOUNDS, PYRAMID, WINDOW_COUNTS),
    sql="""select view_id, v.zoom<11 as clustered, coalesce(n,0) as visible
from vb v left join window_counts c on c.zoom=v.zoom and c.minlon=v.minlon and c.minlat=v.minlat
  and c.maxlon=v.maxlon and c.maxlat=v.maxlat""",
)
def view_count_stream(spark, stream, load):
    index = storage.new_path(spark, "view-index")
    events.store_view_index(load("accidents"), index)
    path = storage.new_path(spark, "view-counts")
    state = storage.new_path(spark, "view-counts-state")
    events.view_count_stream(stream("views"), index, path, state).awaitTermination()
    return spark.read.parquet(path).select("view_id", "clustered", "visible")
