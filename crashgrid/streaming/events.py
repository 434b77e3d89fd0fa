"""Streams of search input, checkbox toggles and view changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crashgrid import model
from crashgrid.operators import clusters, sessions, tree, viewport
from crashgrid.operators.filters import accident_filter, min_query_length


RUN_ONCE = {"availableNow": True}


def read_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream over Parquet files; ``path`` is a folder or a glob of files or folders."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _event_time(ts: str) -> Column:
    # Watermarks need a timestamp with a zone; the session zone applies.
    return F.col(ts).cast("timestamp")


def debounce_stream(
    events: DataFrame,
    key: str = "user_id",
    ts: str = "ts",
    order: str = "event_id",
    value: str = "q",
    gap: str = model.SEARCH_DEBOUNCE,
    delay: str = "10 seconds",
    min_len: int = model.SEARCH_MIN_LENGTH,
) -> DataFrame:
    """Texts that fire (key, fired_at, value), emitted once their session is closed.

    Append mode: a burst is emitted when the watermark, ``delay`` behind the latest
    event, passes its end. Events older than the watermark are dropped.
    """
    timed = events.withColumn(ts, _event_time(ts)).withWatermark(ts, delay)
    last = F.max_by(value, F.struct(ts, order)).alias(value)
    bursts = timed.groupBy(key, F.session_window(ts, gap).alias("burst")).agg(last)
    fired = bursts.select(key, F.col("burst.end").alias("fired_at"), value)
    return fired.where(min_query_length(F.col(value), min_len))


def append_to(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict = RUN_ONCE
) -> StreamingQuery:
    """Write a stream in append mode to Parquet; by default until its input is used up."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def last_toggles_stream(toggles: DataFrame) -> DataFrame:
    """Update-mode stream of box states: (session_id, grp, val, ts, event_id, checked)."""
    timed = toggles.withColumn("ts", _event_time("ts"))
    latest = F.max(F.struct("ts", "event_id", "checked")).alias("last")
    return timed.groupBy("session_id", "grp", "val").agg(latest).select(
        "session_id", "grp", "val", "last.*"
    )


def update_into(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    trigger: dict = RUN_ONCE,
    reread: bool = False,
) -> StreamingQuery:
    """Write each batch of changed rows to ``path/batch=<id>``.

    ``reread`` holds a batch that ``transform`` reads several times; not for a stream with
    state. A batch that is replayed after a failure overwrites its own folder, so no row
    is written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if reread:
            batch = batch.persist()
        try:
            transform(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            if reread:
                batch.unpersist()

    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def selection_table(spark: SparkSession, path: str) -> DataFrame:
    """Current filter state per session from the changes written by ``update_into``."""
    changes = spark.read.parquet(path)
    return sessions.selection_state(changes)


def store_view_index(
    accidents: DataFrame, path: str, state: model.FilterState | None = None
) -> None:
    """Store what ``view_count_stream`` reads: the clusters and the tree of filtered points."""
    kept = accidents if state is None else accident_filter(accidents, state)
    clusters.cluster_pyramid(accidents).write.mode("overwrite").parquet(f"{path}/clusters")
    tree.write_tree(kept.select("OBJECTID", "lon", "lat"), f"{path}/tree")


def view_count_stream(
    views: DataFrame, index: str, path: str, checkpoint: str, trigger: dict = RUN_ONCE
) -> StreamingQuery:
    """Count the accidents of every view change, batch by batch, into ``path``.

    ``index`` is the folder of ``store_view_index``. A batch opens only the folders of the
    tree that its views touch, and of them the leaves on the outline of a window.
    """

    def count(batch: DataFrame) -> DataFrame:
        spark = batch.sparkSession
        near = viewport.with_bounds(batch).where(F.col("zoom") >= model.CLUSTER_ZOOM_LIMIT)
        parts = tree.parts_of(spark, f"{index}/tree", near)
        stored = tree.read_tree(spark, f"{index}/tree", tree.POINT, parts)
        pyramid = spark.read.schema(clusters.SCHEMA).parquet(f"{index}/clusters")
        return viewport.view_counts(batch, pyramid=pyramid, index=stored)

    return update_into(views, path, checkpoint, count, trigger, reread=True)
