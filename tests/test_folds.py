"""Streams with table state: bursts close by time, idle sessions end, late rows are kept."""

import datetime as dt
import random

from pyspark.sql import functions as F

from crashgrid.operators import sessions
from crashgrid.sources import storage
from crashgrid.streaming import folds

KEYS = "user_id bigint, event_id int, ts timestamp, q string"
TOGGLES = "session_id bigint, grp string, val string, ts timestamp, event_id bigint, checked boolean"


def at(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


def feed(spark, source, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(schema).parquet(source)


def test_late_rows_are_kept_and_open_bursts_close(spark, tmp_path):
    batches = [
        [(1, 1, at(0), "be"), (1, 2, at(200), "ber")],
        [(1, 3, at(300), "berg"), (2, 4, at(60_000), "ulm")],
        [(3, 5, at(1_000), "late"), (2, 6, at(120_000), "ulmen"), (4, 7, None, "never")],
    ]
    path, source = str(tmp_path / "out"), str(tmp_path / "in")
    for rows in batches:
        stream = feed(spark, source, KEYS, rows)
        folds.debounce_fold(stream, path, str(tmp_path / "state")).awaitTermination()
    got = lambda: sorted((r.user_id, r.q) for r in spark.read.parquet(f"{path}/fired").collect())
    assert got() == [(1, "berg"), (2, "ulm")]
    late = spark.read.parquet(f"{path}/late").collect()
    assert sorted(r.event_id for r in late) == [5, 7]
    folds.close_bursts(spark, path, stream)
    folds.close_bursts(spark, path, stream)
    assert got() == [(1, "berg"), (2, "ulm"), (2, "ulmen")]


def test_a_clock_closes_bursts_without_another_keystroke(spark, tmp_path):
    source, ticks, path = str(tmp_path / "in"), str(tmp_path / "ticks"), str(tmp_path / "out")
    stream = feed(spark, source, KEYS, [(1, 1, at(0), "berg")])

    def run(tick):
        clock = feed(spark, ticks, "ts timestamp", [(tick,)])
        folds.debounce_fold(stream, path, str(tmp_path / "state"), clock=clock).awaitTermination()
        return [r.q for r in spark.read.parquet(f"{path}/fired").collect()]

    assert run(at(5_000)) == []
    assert run(at(10_251)) == ["berg"]
    assert run(at(99_000)) == ["berg"]
    assert spark.read.parquet(f"{path}/late").count() == 0


def test_random_arrivals_equal_the_batch_operator_on_rows_in_time(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        t = i * 120 + rng.randint(0, 400)
        rows.append((rng.randint(1, 5), i, at(t - (rng.randint(0, 30_000) if rng.random() < 0.1 else 0)), rng.choice(["a", "ab", "abc"])))
    path, source = str(tmp_path / "out"), str(tmp_path / "in")
    for first in range(0, 400, 50):
        stream = feed(spark, source, KEYS, rows[first : first + 50])
        folds.debounce_fold(stream, path, str(tmp_path / "state"), delay="2 seconds").awaitTermination()
    folds.close_bursts(spark, path, stream)
    late = {r.event_id for r in spark.read.parquet(f"{path}/late").collect()}
    assert late and len(late) < 100
    in_time = spark.createDataFrame([r for r in rows if r[1] not in late], KEYS)
    want = sorted(map(tuple, sessions.debounce(in_time).collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{path}/fired").select("user_id", "fired_at", "q").collect())) == want
    # A replayed batch finds the state before it and leaves the same files.
    assert len(storage.names_in(spark, f"{path}/state")) == folds.KEEP_STATES


def test_idle_sessions_end_and_the_state_shrinks(spark, tmp_path):
    path, source = str(tmp_path / "out"), str(tmp_path / "in")
    hour = 3_600_000
    batches = [
        [(s, "UART", str(v), at(s), 10 * s + v, False) for s in range(1, 51) for v in range(3)],
        [(1, "UART", "5", at(20 * hour), 1000, False)],
        [(2, "UKATEGORIE", "1", at(40 * hour), 1001, False), (9, "UART", "1", at(2), 1002, True)],
    ]
    sizes = []
    for rows in batches:
        stream = feed(spark, source, TOGGLES, rows)
        folds.selection_fold(stream, path, str(tmp_path / "state"), idle="1 day", delay="1 hour").awaitTermination()
        state = folds.read_state(spark, path, TOGGLES, folds.last_batch(spark, path))
        sizes.append(state.count())
    assert sizes == [150, 151, 5]
    live = {r.session_id: r.s for r in folds.selection_now(spark, path, TOGGLES).select("session_id", sessions.selection_lists(F.col("mask")).alias("s")).collect()}
    assert set(live) == {1, 2}
    assert 5 not in live[1].uart and 0 not in live[1].uart
    # Session 2 had ended: its old boxes are checked again.
    assert live[2].ukategorie == [2, 3] and len(live[2].uart) == 10
    ended = spark.read.parquet(f"{path}/ended").collect()
    assert sorted(r.session_id for r in ended) == list(range(2, 51))
    assert [r.event_id for r in spark.read.parquet(f"{path}/late").collect()] == [1002]
    # Session 1 toggled all the time, so its first boxes are still known.
    assert 1 not in live[1].uart
    # What a reader opens is one folder, however many batches there were.
    assert all("batch=2" in f for f in folds.read_state(spark, path, TOGGLES, folds.last_batch(spark, path)).inputFiles())


def test_results_before_the_first_batch(spark, tmp_path):
    path = str(tmp_path / "nothing")
    assert folds.last_batch(spark, path) == -1
    assert folds.selection_now(spark, path, TOGGLES).count() == 0
    assert folds.read_results(spark, path, "fired", "q string").count() == 0
    assert folds.seconds("250 milliseconds") == 0.25 and folds.seconds("6 hours") == 21600
