"""Debounce and selection, batch against stream and with late events."""

import datetime as dt

from pyspark.sql import functions as F

from crashgrid.operators import sessions
from crashgrid.streaming import events


def at(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


KEYS = "user_id bigint, event_id int, ts timestamp, q string"


def test_debounce_rules(spark):
    rows = [
        (1, 1, at(0), "b"),
        (1, 2, at(100), "be"),
        (1, 3, at(350), "ber"),  # exactly one gap later still supersedes
        (1, 4, at(601), "berg"),  # more than a gap later: both fire
        (2, 5, at(0), "ulm"),
        (2, 6, at(10), "u"),  # too short, and it cancels the one before
        (3, 7, at(5), "aa"),
        (3, 8, at(5), "bb"),  # same time: the later event id wins
        (4, 9, at(3_599_900), "x1"),  # next event lies in the next hour slot
        (4, 10, at(3_600_050), "x2"),
    ]
    df = spark.createDataFrame(rows, KEYS)
    got = sorted((r.user_id, r.fired_at, r.q) for r in sessions.debounce(df).collect())
    assert got == [
        (1, at(600), "ber"),
        (1, at(851), "berg"),
        (3, at(255), "bb"),
        (4, at(3_600_300), "x2"),
    ]


def run_batches(spark, tmp_path, schema, batches, build):
    """Feed one file per micro-batch and run the stream after each."""
    source = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        build(spark.readStream.schema(schema).parquet(source)).awaitTermination()


def test_stream_drops_late_and_keeps_open_bursts(spark, tmp_path):
    batches = [
        [(1, 1, at(0), "be"), (1, 2, at(200), "ber")],
        [(1, 3, at(300), "berg"), (2, 4, at(60_000), "ulm")],
        [(3, 5, at(1_000), "late"), (2, 6, at(120_000), "ulmen")],
    ]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def build(stream):
        return events.append_to(events.debounce_stream(stream, delay="10 seconds"), out, state)

    run_batches(spark, tmp_path, KEYS, batches, build)
    got = sorted((r.user_id, r.q) for r in spark.read.parquet(out).collect())
    # User 3 came after the watermark; the last burst of user 2 is still open.
    assert got == [(1, "berg"), (2, "ulm")]


def test_nothing_is_emitted_before_the_watermark(spark, load, tmp_path):
    rows = load("keystrokes").withColumn("ts", F.col("ts").cast("timestamp"))
    schema = rows.schema
    source = str(tmp_path / "in")
    rows.repartitionByRange(3, "ts").write.parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    fired = events.debounce_stream(stream, gap="6 hours", delay="31 days")
    events.append_to(fired, out, str(tmp_path / "state")).awaitTermination()
    # The watermark lies before every event here, so all bursts stay open.
    assert spark.read.schema(fired.schema).parquet(out).count() == 0
    batch = sessions.debounce(rows, gap_seconds=6 * 3600)
    assert batch.count() == 425


def test_selection_over_several_batches(spark, tmp_path):
    schema = "session_id bigint, event_id bigint, ts timestamp, grp string, val string, checked boolean"
    batches = [
        [(1, 1, at(0), "UART", "5", False), (2, 2, at(0), "UART", "42", False)],
        [(1, 3, at(10), "UART", "5", True), (1, 4, at(11), "BETEILIGUNG", "IstRad", False)],
        [(1, 5, at(5), "BETEILIGUNG", "IstRad", True)],  # older than what is known
    ]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def build(stream):
        return events.update_into(events.last_toggles_stream(stream), out, state)

    run_batches(spark, tmp_path, schema, batches, build)
    states = events.selection_table(spark, out)
    got = {r.session_id: r.s for r in states.select("session_id", sessions.selection_lists(F.col("mask")).alias("s")).collect()}
    assert got[1].flags == ["IstPKW", "IstFuss", "IstKrad", "IstGkfz", "IstSonstig"]
    assert got[1].uart == [1, 2, 3, 4, 5, 6, 7, 8, 9, 0]
    assert len(got[2].uart) == 10 and len(got[2].flags) == 6
    every = [r for b in batches for r in b]
    batch = sessions.selection_state(spark.createDataFrame(every, schema))
    assert sorted(map(tuple, states.collect())) == sorted(map(tuple, batch.collect()))
