"""Run-length tables against brute force, with long runs and bucket edges."""

import random

import pytest
from pyspark.sql import functions as F

from crashgrid.operators import tiles
from crashgrid.operators.skew import sized_join
from crashgrid.plans import catalog


def runs_of(contents):
    """Runs of a {tile_id: content} mapping, one tile at a time."""
    runs = []
    for tid in sorted(contents):
        if runs and runs[-1][0] + runs[-1][1] == tid and runs[-1][2] == contents[tid]:
            runs[-1][1] += 1
        else:
            runs.append([tid, 1, contents[tid]])
    return sorted(map(tuple, runs))


@pytest.mark.parametrize("bits", [(3, 6, 53), (1, 2, 53), (18, 36, 53)])
def test_compact_runs_across_buckets(spark, monkeypatch, bits):
    rng = random.Random(4)
    contents, tid = {}, 0
    while tid < 3000:
        value = rng.choice([1, 1, 1, 2, None])
        for _ in range(rng.choice([1, 2, 7, 40, 300])):
            contents[tid] = value
            tid += 1
        tid += rng.choice([0, 0, 1, 9])
    monkeypatch.setattr(tiles, "COMPACT_BITS", bits)
    df = spark.createDataFrame(list(contents.items()), "tile_id bigint, content int").repartition(5)
    got = tiles.compact_runs(df)
    key = lambda r: (r[0], r[1], str(r[2]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(runs_of(contents), key=key)
    assert sorted(map(tuple, tiles.expand_runs(got).collect()), key=str) == sorted(contents.items(), key=str)


def test_lookup_with_long_runs(spark):
    rng = random.Random(7)
    entries, start = [], 5
    for i in range(200):
        length = rng.choice([0, 1, 3, 63, 64, 65, 200, 4096, 100_000, 20_000_000])
        entries.append((start, length, i))
        start += length + rng.choice([0, 1, 50])
    ids = [rng.randrange(0, start + 100) for _ in range(3000)]
    ids += [e[0] for e in entries] + [e[0] + e[1] - 1 for e in entries] + [e[0] + e[1] for e in entries]
    requests = spark.createDataFrame(list(enumerate(ids)), "request_id bigint, tile_id bigint")
    table = spark.createDataFrame(entries, "tile_id bigint, run_length bigint, data_offset bigint")

    def owner(q):
        return next((o for s, n, o in entries if s <= q < s + n), None)

    want = {(i, owner(q)) for i, q in enumerate(ids)}
    got = tiles.tile_lookup(requests, table).select("request_id", "data_offset").collect()
    assert sorted(map(tuple, got)) == sorted(w for w in want if w[1] is not None)
    missing = tiles.missing_tiles(requests, table).collect()
    assert sorted(r.request_id for r in missing) == sorted(w[0] for w in want if w[1] is None)
    assert missing and got
    with pytest.raises(Exception, match="tile not found"):
        tiles.missing_tiles(requests, table, strict=True).collect()


def test_requests_without_id_are_missing(spark, load):
    requests = tiles.parse_requests(load("tile_urls"))
    bad = requests.where("bad_url")
    assert bad.count() == 20
    missing = tiles.missing_tiles(requests.select("request_id", "tile_id"), load("tile_entries"))
    assert bad.join(missing, "request_id", "left_anti").count() == 0


SPLIT = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def splitting(spark):
    """Adaptive execution that splits small partitions already, without reusing exchanges."""
    before = {k: spark.conf.get(k) for k in [*SPLIT, "spark.sql.exchange.reuse"]}
    for k, v in {**SPLIT, "spark.sql.exchange.reuse": "false"}.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_are_split(spark, splitting, how):
    # Many equal rows share one key, as in a log without request ids; some have no key.
    key = F.expr("case when id % 3 = 0 then 1 when id % 7 = 0 then null else id % 500 end")
    big = spark.range(0, 30_000, 1, 20).select(F.lit("https://tile").alias("url"), key.alias("k"))
    small = spark.range(600).select((F.col("id") % 400).alias("k"), F.col("id").alias("v"))
    want = big.join(small, "k", how).groupBy(big.join(small, "k", how).columns).count().collect()
    joined = sized_join(big, small, ["k"], how)
    got = joined.groupBy(joined.columns).count().collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    single = sized_join(big, small, ["k"], how)
    single.write.format("noop").mode("overwrite").save()
    single.collect()
    assert "skew=true" in single._jdf.queryExecution().executedPlan().toString()


def test_runs_of_any_length(spark):
    runs = spark.createDataFrame([(7, 3_000_000_000, "a"), (1 << 40, 5, "b"), (1 << 50, 0, "c")], "tile_id bigint, run_length bigint, content string")
    blocks = tiles.expand_blocks(runs)
    found = blocks.groupBy("content").agg(F.sum("run_length").alias("n"), F.min("tile_id").alias("lo"), F.max(F.expr("tile_id + run_length")).alias("hi"), F.max("run_length").alias("most"))
    assert sorted(map(tuple, found.collect())) == [("a", 3_000_000_000, 7, 3_000_000_007, 1 << 20), ("b", 5, 1 << 40, (1 << 40) + 5, 5)]
    asked = spark.createDataFrame([(1, 7), (2, 6), (3, 3_000_000_006), (4, 3_000_000_007), (5, None), (6, 3_000_000_006)], "id int, tile_id bigint")
    assert {r.id for r in tiles.missing_tiles(asked, runs).collect()} == {2, 4, 5}
    assert {r.id for r in tiles.tile_lookup(asked, runs).collect()} == {1, 3, 6}


def test_tilejson(load):
    summary = tiles.tileset_summary(load("tile_entries"), load("accidents"), exact=False)
    doc = tiles.tilejson(summary, "https://tiles.example", 1).first().tilejson
    assert doc.tiles == ["https://tiles.example/{z}/{x}/{y}.mvt"]
    assert (doc.tilejson, doc.scheme, doc.minzoom, doc.maxzoom) == ("3.0.0", "xyz", 11, 11)
    assert doc.bounds[0] < doc.center[0] < doc.bounds[2]
    assert doc.vector_layers == [] and doc.name is None


def test_fixed_point_degrees_beyond_32_bits(spark, tmp_path):
    """Offsets of large tables, times 100, don't fit into 32 bits."""
    keys = [1, 22_374, 22_375, 30_000, 1_200_000]
    rows = [(k, 1 + k % 50) for k in keys]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.tile_id: r.deg for r in catalog.QUERIES["fixed_point_degrees"](spark, str(tmp_path)).collect()}
    assert got == {1398101 + k * 7: (k * 100_000 - 90_000_000) / 1e7 for k in keys}
