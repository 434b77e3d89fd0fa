"""Interval look-up of tile ids against brute force, over runs of all lengths."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from crashgrid.operators import tiles


def brute_force(asked, runs):
    starts = [r[0] for r in runs]
    out = []
    for rid, tid in asked:
        at = bisect.bisect_right(starts, tid) - 1 if tid is not None else -1
        if at >= 0 and tid < runs[at][0] + runs[at][1]:
            out.append((rid, tid, *runs[at]))
    return sorted(out)


@pytest.mark.parametrize("bits", [18, 3])
def test_lookup_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(tiles, "LOOK_BITS", bits)
    monkeypatch.setattr(tiles, "ID_BITS", 53 if bits == 18 else 21)
    top = 1 << (52 if bits == 18 else 20)
    rng = random.Random(bits)
    runs, at = [], 0
    for i in range(400):
        at += rng.choice([0, 0, 1, 5, rng.randrange(top // 800)])
        length = rng.choice([1, 2, 100, rng.randrange(1, top // 800)])
        runs.append((at, length, f"c{i}"))
        at += length
    edges = [t + d for t, n, _ in runs for d in (-1, 0, n - 1, n)]
    asked = list(enumerate([e for e in edges if e >= 0] + [rng.randrange(top) for _ in range(500)] + [None, top]))
    asked += [(10_000 + i, runs[7][0]) for i in range(300)]
    requests = spark.createDataFrame(asked, "request_id int, tile_id bigint")
    table = spark.createDataFrame(runs, "tile_id bigint, run_length bigint, content string")
    odd = spark.createDataFrame([(None, 5, "x"), (3, 0, "y"), (4, None, "z")], table.schema)
    got = tiles.tile_lookup(requests, table.unionByName(odd))
    assert got.columns == ["request_id", "tile_id", "run_start", "run_length", "content"]
    assert sorted(map(tuple, got.collect())) == brute_force(asked, runs)


def test_empty_sides(spark):
    requests = spark.createDataFrame([(1, 5)], "request_id int, tile_id bigint")
    table = spark.createDataFrame([(5, 1)], "tile_id bigint, run_length bigint")
    assert tiles.tile_lookup(requests, table.where("false")).count() == 0
    assert tiles.tile_lookup(requests.where("false"), table).count() == 0
    assert tiles.tile_lookup(requests, table).count() == 1


def test_requests_are_shuffled_once_and_a_hot_tile_is_split(spark, tmp_path):
    hot = F.when(F.col("id") % 10 != 0, 7).otherwise(F.col("id"))
    spark.range(100_000).select(hot.alias("tile_id"), F.sha2(F.col("id").cast("string"), 256).alias("pad")).repartition(8).write.parquet(str(tmp_path / "r"))
    table = spark.createDataFrame([(0, 50), (60, 100_000)], "tile_id bigint, run_length bigint")
    low = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        df = tiles.tile_lookup(spark.read.parquet(str(tmp_path / "r")), table)
        assert len(df.collect()) == 100_000 - 1  # id 50
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "skew=true" in plan
    # The wide column of the requests goes through one exchange.
    assert plan.count("FileScan parquet [tile_id") == 2 and plan.count("pad") > 0
