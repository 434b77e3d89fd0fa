"""Streams whose state is a table of the shared folder: it ends, and late rows are kept.

Every micro-batch reads the state that the batch before wrote and writes its own, next to its
results and the rows that came too late. All folders carry the number of the batch, so a batch
that is replayed after a failure overwrites what it wrote and reads what it read before.
Of the state only the last two batches are kept, so what a reader meets does not grow with
the number of batches.

The watermark of a batch lies ``delay`` behind the latest event of all batches before. Rows
older than it are late. Rows without a key are ticks of a clock: they only move the time on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crashgrid import model
from crashgrid.operators import sessions
from crashgrid.sources import storage
from crashgrid.streaming.events import RUN_ONCE

STATE, MARK, LATE = "state", "mark", "late"
KEEP_STATES = 2


@dataclass(frozen=True)
class Step:
    """What a batch has: the state before it, its rows in time, and the time after it (microseconds)."""

    state: DataFrame
    rows: DataFrame
    watermark: int


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def seconds(text: str) -> float:
    """A length of time such as ``250 milliseconds`` in seconds."""
    number, unit = text.split()
    sizes = {"microsecond": 1e-6, "millisecond": 1e-3, "second": 1, "minute": 60, "hour": 3600, "day": 86400}
    return float(number) * sizes[unit.rstrip("s")]


def fold(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    step: Callable[[Step], dict[str, DataFrame]],
    key: str,
    ts: str = "ts",
    delay: str = "10 seconds",
    trigger: dict = RUN_ONCE,
) -> StreamingQuery:
    """Run ``step`` for every batch and write the tables it returns to ``path/<name>/batch=<id>``.

    ``step`` returns a table ``state`` with the columns of the stream, and any others. Rows
    without a time are late, too.
    """
    columns = stream.columns

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            latest = _mark(spark, path, batch_id - 1)
            now = batch.agg(F.max(micros(ts)).alias("t")).first().t
            before = None if latest is None else latest - round(seconds(delay) * 1_000_000)
            known = [t for t in (latest, now) if t is not None]
            after = max(known) - round(seconds(delay) * 1_000_000) if known else -(1 << 62)
            rows = batch.where(F.col(key).isNotNull())
            late = micros(ts).isNull() if before is None else F.coalesce(micros(ts) < before, F.lit(True))
            state = read_state(spark, path, batch.schema, batch_id - 1)
            out = step(Step(state, rows.where(~late), after)) | {LATE: rows.where(late)}
            out[MARK] = spark.range(1).select(F.lit(max(known) if known else None).cast("bigint").alias("t"))
            for name, table in out.items():
                table.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()
        storage.remove(spark, f"{path}/{STATE}/batch={batch_id - KEEP_STATES}")

    return (
        stream.select(*columns).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def _mark(spark: SparkSession, path: str, batch_id: int) -> int | None:
    """Time of the latest event up to a batch."""
    if batch_id < 0:
        return None
    return spark.read.schema("t bigint").parquet(f"{path}/{MARK}/batch={batch_id}").first().t


def read_state(spark: SparkSession, path: str, schema, batch_id: int) -> DataFrame:
    """The state that a batch left; of a batch before the first one it is empty."""
    if batch_id < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{STATE}/batch={batch_id}")


def last_batch(spark: SparkSession, path: str) -> int:
    """Number of the last complete batch, -1 before the first one."""
    return max((int(name.split("=")[1]) for name in storage.names_in(spark, f"{path}/{MARK}") if name.startswith("batch=")), default=-1)


def read_results(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    """All rows of one result table, whatever batch wrote them."""
    if not storage.names_in(spark, f"{path}/{name}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def debounce_fold(
    events: DataFrame,
    path: str,
    checkpoint: str,
    key: str = "user_id",
    ts: str = "ts",
    order: str = "event_id",
    value: str = "q",
    gap: str = model.SEARCH_DEBOUNCE,
    delay: str = "10 seconds",
    min_len: int = model.SEARCH_MIN_LENGTH,
    clock: DataFrame | None = None,
    trigger: dict = RUN_ONCE,
) -> StreamingQuery:
    """Texts that fire, in ``path/fired``; rows that came too late, in ``path/late``.

    A burst closes when the watermark passes its end, moved on by later events or by
    ``clock``, a stream with a column ``ts`` (a rate source, say) that fires bursts when nobody
    types any more. ``close_bursts`` fires what is open when the input has ended. The
    texts are those of the batch operator over the rows that were in time. The state
    holds the events of the last gap and delay.
    """
    columns = [key, ts, order, value]
    stream = events.select(key, F.col(ts).cast("timestamp").alias(ts), order, value)
    if clock is not None:
        typed = {f.name: f.dataType for f in stream.schema.fields}
        ticks = clock.select(F.col("ts").cast("timestamp").alias(ts))
        stream = stream.unionByName(ticks.select(*[F.col(c) if c == ts else F.lit(None).cast(typed[c]).alias(c) for c in columns]))
    wide = round(seconds(gap) * 1_000_000)

    def step(s: Step) -> dict[str, DataFrame]:
        known = s.state.unionByName(s.rows)
        fired = sessions.debounce(known, key, ts, order, value, seconds(gap), min_len)
        return {
            "fired": fired.where(micros("fired_at") < s.watermark),
            STATE: known.where(micros(ts) + wide >= s.watermark),
        }

    return fold(stream, path, checkpoint, step, key, ts, delay, trigger)


def close_bursts(
    spark: SparkSession,
    path: str,
    events: DataFrame,
    key: str = "user_id",
    ts: str = "ts",
    order: str = "event_id",
    value: str = "q",
    gap: str = model.SEARCH_DEBOUNCE,
    min_len: int = model.SEARCH_MIN_LENGTH,
) -> None:
    """Fire the bursts that are open at the end of the input of ``debounce_fold``; may be repeated."""
    last = last_batch(spark, path)
    schema = events.select(key, F.col(ts).cast("timestamp").alias(ts), order, value).schema
    open_rows = read_state(spark, path, schema, last)
    fired = sessions.debounce(open_rows, key, ts, order, value, seconds(gap), min_len)
    fired.write.mode("overwrite").parquet(f"{path}/fired/batch={last + 1}")


def selection_fold(
    toggles: DataFrame,
    path: str,
    checkpoint: str,
    idle: str = "1 day",
    delay: str = "10 seconds",
    trigger: dict = RUN_ONCE,
) -> StreamingQuery:
    """Box states of live sessions as a table that each batch replaces, see ``selection_now``.

    A session without a toggle for ``idle`` ends: its last selection goes to
    ``path/ended`` (session_id, began, mask) and its boxes leave the state. If it comes back,
    all its boxes are checked, as on a page that is opened anew.
    """
    columns = ["session_id", "grp", "val", "ts", "event_id", "checked"]
    stream = toggles.withColumn("ts", F.col("ts").cast("timestamp")).select(*columns)
    quiet = round(seconds(idle) * 1_000_000)

    def step(s: Step) -> dict[str, DataFrame]:
        # What the state holds of a session is one visit, active until its last toggle.
        last = s.state.groupBy("session_id").agg(F.max("ts").alias("active"))
        known = s.state.join(last, "session_id").unionByName(s.rows.withColumn("active", F.col("ts")))
        visits = known.groupBy("session_id", F.session_window("active", idle).alias("visit")).agg(F.max("active").alias("until"))
        newest = F.max("began").over(Window.partitionBy("session_id")) == F.col("began")
        visits = visits.select("session_id", F.col("visit.start").alias("began"), "until").withColumn("newest", newest)
        latest = F.max(F.struct("ts", "event_id", "checked")).alias("last")
        boxes = (
            known.join(visits, "session_id")
            .where(F.col("active").between(F.col("began"), F.col("until")))
            .groupBy("session_id", "began", "until", "newest", "grp", "val")
            .agg(latest)
            .select("session_id", "began", "newest", "until", "grp", "val", "last.*")
        )
        boxes = storage.materialise(boxes, "boxes")  # read twice
        over = ~F.col("newest") | (micros("until") + quiet < s.watermark)
        visit = F.struct("session_id", "began").alias("session_id")
        ended = sessions.selection_state(boxes.where(over).select(visit, "grp", "val", "ts", "event_id", "checked"))
        return {"ended": ended.select("session_id.*", "mask"), STATE: boxes.where(~over).select(*columns)}

    return fold(stream, path, checkpoint, step, "session_id", "ts", delay, trigger)


def selection_now(spark: SparkSession, path: str, schema) -> DataFrame:
    """Selection (session_id, mask) of every live session after the last batch."""
    return sessions.selection_state(read_state(spark, path, schema, last_batch(spark, path)))
