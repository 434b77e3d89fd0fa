"""Place search by posting lists: against brute force, with long names and with hot texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from crashgrid.operators import search, sessions
from crashgrid.operators.skew import dealt_anew, sized_join

PLACES = "place_id bigint, name string, city string, country string, lon double, lat double"
LOW = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.files.maxPartitionBytes": "64k",
    "spark.sql.files.openCostInBytes": "0",
}


@pytest.fixture
def low_thresholds(spark):
    before = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def brute_force(asked, rows, k):
    out = []
    for sid, q in asked:
        t = (q or "").strip(" ").lower()
        if not t:
            continue
        found = []
        for pid, name, *_ in rows:
            n = (name or "").strip(" ").lower()
            if t in n:
                found.append((0 if n == t else 1 if n.startswith(t) else 2, name.encode(), pid))
        out += [(sid, i, pid) for i, (_, _, pid) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5])
def test_equals_brute_force(spark, k):
    rng = random.Random(k)
    letters = ["a", "b", "c", "ß", "é", " ", "😀"]
    names = ["".join(rng.choices(letters, k=rng.randint(0, 9))) for _ in range(400)]
    rows = [(i, rng.choice([n, n.upper(), f" {n} "]), None, None, 10.0, 50.0) for i, n in enumerate(names)]
    rows += [(1000 + i, "abc", None, None, 10.0, 50.0) for i in range(9)] + [(2000, None, None, None, 10.0, 50.0)]
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(300)] + ["abc", "ABC", "", "  ", None, "zzz", "ab", "😀"]
    asked = list(enumerate(texts))
    # Upper-casing the sharp s makes two letters; lower-casing does not undo it.
    places = spark.createDataFrame(rows, PLACES)
    queries = spark.createDataFrame(asked, "search_id int, q string")
    want = brute_force(asked, rows, k)
    got = search.geocode(queries, places, k=k).select("search_id", "position", "place_id").collect()
    assert sorted(map(tuple, got)) == want
    stored = search.search_index(places, 5)
    got = search.geocode(queries, places, k=k, index=stored).select("search_id", "position", "place_id").collect()
    assert sorted(map(tuple, got)) == want


def test_index_grows_with_the_length_of_names(spark):
    rng = random.Random(1)
    name = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    rows = [(1, name, None, None, 10.0, 50.0), (2, "x", None, None, 10.0, 50.0)]
    places = spark.createDataFrame(rows, PLACES)
    assert search.search_index(places).count() <= 3 * len(name) + 1
    asked = spark.createDataFrame([(1, name[7000:7100]), (2, name), (3, name + "y"), (4, name[:15_000])], "search_id int, q string")
    began = time.time()
    got = sorted((r.search_id, r.place_id) for r in search.geocode(asked, places).collect())
    assert got == [(1, 1), (2, 1), (4, 1)]
    assert time.time() - began < 60


def test_a_text_probes_its_rarest_gram(spark):
    rows = [(i, f"strasse {i}", None, None, 10.0, 50.0) for i in range(50)] + [(99, "qstrasse", None, None, 10.0, 50.0)]
    index = search.search_index(spark.createDataFrame(rows, PLACES))
    texts = spark.createDataFrame([("qstrasse",), ("strasse",), ("xstrasse",)], "text string")
    parts = search._with_grams(texts, "text")
    got = {r.text: r.gram for r in search._rarest(parts, index.select("gram")).collect()}
    assert got["qstrasse"] in ("q", "qs", "qst") and "xstrasse" not in got and set(got) == {"qstrasse", "strasse"}


def test_a_hot_text_is_split_over_tasks(spark, tmp_path, low_thresholds):
    rows = [(i, f"Platz {i}", None, None, 10.0, 50.0) for i in range(100)]
    places = spark.createDataFrame(rows, PLACES)
    text = F.when(F.col("id") % 10 != 0, "platz").otherwise(F.concat(F.lit("platz "), F.col("id") % 100))
    spark.range(200_000).select("id", text.alias("q"), F.sha2(F.col("id").cast("string"), 256).alias("pad")).write.parquet(str(tmp_path / "q"))
    queries = spark.read.parquet(str(tmp_path / "q"))
    for k in (5, 1):
        plan = final_plan(search.geocode(queries, places, k=k))
        assert "skew=true" in plan


def test_a_hot_session_is_split_over_tasks(spark, tmp_path, low_thresholds):
    session = F.when(F.col("id") % 10 != 0, 7).otherwise(F.col("id"))
    spark.range(100_000).select(F.col("id").alias("view_id"), session.alias("session_id"), F.sha2(F.col("id").cast("string"), 256).alias("pad")).write.parquet(
        str(tmp_path / "v")
    )
    toggles = spark.range(1000).selectExpr("id as session_id", "id as event_id", "timestamp_micros(id) as ts", "'UART' as grp", "'5' as val", "false as checked")
    df = sessions.with_state(spark.read.parquet(str(tmp_path / "v")), sessions.selection_state(toggles))
    assert "skew=true" in final_plan(df)


def test_dealt_anew_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "a", 2), (None, "b", 3), (1, None, 4)], "k int, t string, v int")
    again = dealt_anew(df, ["t", "k"])
    assert again.columns == df.columns and again.exceptAll(df).count() == 0 and again.count() == 3
    left = spark.createDataFrame([(1, 10), (2, 20)], "k int, w int")
    assert sized_join(left, dealt_anew(df, ["k"]), ["k"], "left").count() == 3
