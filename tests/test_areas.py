"""Clusters, views, cursors and search beyond the registered inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from crashgrid import model
from crashgrid.operators import clusters as cl
from crashgrid.operators import grid, search, viewport
from crashgrid.operators.pick import pick
from crashgrid.sources import pyramid, scans, storage


def test_counts_are_kept_on_every_level(load):
    sums = cl.cluster_pyramid(load("accidents")).groupBy("zoom").agg(F.sum("point_count").alias("n"))
    assert {r.zoom: r.n for r in sums.collect()} == {z: 6000 for z in range(6, 11)}


def test_pyramid_equals_single_levels(load):
    df = load("accidents")
    every = cl.cluster_pyramid(df)
    for zoom in (6, 9, 10):
        one = cl.cluster_points(df, zoom)
        assert one.exceptAll(every.where(F.col("zoom") == zoom)).count() == 0


def test_golden_cells(load):
    rows = cl.cluster_points(load("accidents"), 9).collect()
    assert (len(rows), max(r.point_count for r in rows)) == (141, 92)


@pytest.fixture(scope="module")
def crowd(spark):
    """Points of which a third lie on one spot and a third in one small area."""
    rng = random.Random(11)
    rows = []
    for i in range(6000):
        if i % 3 == 0:
            lon, lat = 13.4, 52.5
        elif i % 3 == 1:
            lon, lat = 13.4 + rng.uniform(-2e-3, 2e-3), 52.5 + rng.uniform(-2e-3, 2e-3)
        else:
            lon, lat = rng.uniform(5.9, 15), rng.uniform(47.3, 55)
        rows.append((i, lon, lat))
    rows += [(7001, None, 52.5), (7002, 13.4, None)]
    return rows, spark.createDataFrame(rows, "OBJECTID bigint, lon double, lat double")


def test_box_counts_on_a_crowd(spark, crowd):
    rows, df = crowd
    rng = random.Random(5)
    views = [
        (i, 13.4 + rng.uniform(-0.02, 0.02), 52.5 + rng.uniform(-0.02, 0.02), rng.choice([11.0, 12.5, 14.0, 16.9, 17.0, 19.5, 20.0]), 800, 600)
        for i in range(300)
    ]
    views += [(1000 + i, 13.4, 52.5, 11.0, 1024, 768) for i in range(200)]
    v = spark.createDataFrame(views, "view_id int, center_lon double, center_lat double, zoom double, width_px int, height_px int")
    got = {r.view_id: r.visible for r in viewport.view_counts(v, df).collect()}
    assert len(got) == 500
    for r in viewport.with_bounds(v).collect():
        want = sum(
            1
            for _, lon, lat in rows
            if lon is not None and lat is not None and r.minlon <= lon <= r.maxlon and r.minlat <= lat <= r.maxlat
        )
        assert got[r.view_id] == want


def test_views_read_from_a_stored_index(spark, crowd, tmp_path):
    _, df = crowd
    path = str(tmp_path / "grid")
    grid.write_grid(df, path)
    v = spark.createDataFrame(
        [(1, 13.4, 52.5, 12.0, 800, 600), (2, 8.0, 50.0, 11.0, 800, 600), (3, 9.0, 51.0, 7.0, 800, 600)],
        "view_id int, center_lon double, center_lat double, zoom double, width_px int, height_px int",
    )
    boxes = viewport.boxes_of(viewport.with_bounds(v).where("zoom >= 11"))
    stored = grid.read_grid(spark, path, grid.zones_of(boxes))
    clusters = cl.cluster_pyramid(df)
    got = viewport.view_counts(v, pyramid=clusters, index=stored)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, viewport.view_counts(v, df).collect()))
    plan = stored.points._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [zone" in plan or "zone#" in plan.split("PartitionFilters")[1][:60]
    with pytest.raises(ValueError):
        viewport.view_counts(v)


def test_filters_reach_clusters_only_on_request(load):
    df, views = load("accidents"), load("views").where("zoom < 11")
    state = model.FilterState(ukategorie=[1])
    plain = viewport.view_counts(views, df, state)
    assert plain.exceptAll(viewport.view_counts(views, df)).count() == 0
    narrowed = viewport.view_counts(views, df, state, filter_clusters=True)
    total = F.sum("visible").alias("n")
    assert narrowed.agg(total).first().n < plain.agg(total).first().n


def test_pairs_agree_with_counts(load):
    df = load("accidents")
    views = load("views").drop("session_id", "ts")
    pairs = viewport.viewport_join(views, df.select("OBJECTID", "lon", "lat")).groupBy("view_id").count()
    counts = viewport.view_counts(views, df).where("zoom >= 11 and visible > 0")
    assert {r.view_id: r["count"] for r in pairs.collect()} == {r.view_id: r.visible for r in counts.collect()}


def test_pick_against_brute_force(spark, crowd):
    rows, df = crowd
    rng = random.Random(3)
    cursors = [(i, 13.4 + rng.uniform(-3e-3, 3e-3), 52.5 + rng.uniform(-3e-3, 3e-3), rng.choice([11.0, 13.3, 16.0, 20.0, 9.0])) for i in range(200)]
    c = spark.createDataFrame(cursors, "cursor_id int, lon double, lat double, zoom double")
    got = {r.cursor_id: (r.OBJECTID, round(r.distance_px, 6)) for r in pick(c, df).collect()}

    def world(lon, lat):
        phi = math.radians(lat)
        return (lon + 180) / 360, (1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2

    points = [(i, *world(lon, lat)) for i, lon, lat in rows if lon is not None and lat is not None]
    want = {}
    for cid, lon, lat, zoom in cursors:
        if zoom < 11:
            continue
        x, y = world(lon, lat)
        scale = 512 * 2**zoom
        d, i = min((math.hypot(px - x, py - y) * scale, i) for i, px, py in points)
        if d <= 6.5:
            want[cid] = (i, round(d, 6))
    assert got.keys() == want.keys() and len(want) > 20
    for cid in want:
        assert got[cid][0] == want[cid][0] and got[cid][1] == pytest.approx(want[cid][1], abs=1e-5)


def test_search_ranks_and_lengths(spark):
    long_name = "Donaudampfschifffahrtselektrizitätenhauptbetriebswerkbauunterbeamtengesellschaft"
    names = ["Berg", "Bergen", "Oberberg", "Bergheim", "Am Berg", "Bergfeld", "Zell", long_name, "Alt-" + long_name]
    rows = [(i, n, None, "DE", 10.0, 50.0) for i, n in enumerate(names)] + [(99, "Berg", None, "US", -90.0, 40.0)]
    places = spark.createDataFrame(rows, "place_id bigint, name string, city string, country string, lon double, lat double")
    asked = [(1, " BERG "), (2, "z"), (3, ""), (4, long_name.lower()), (5, "nirgends"), (6, long_name[1:75]), (7, long_name + "x")]
    queries = spark.createDataFrame(asked, "search_id int, q string")
    hits = search.geocode(queries, places).orderBy("search_id", "position").collect()
    got = {}
    for h in hits:
        got.setdefault(h.search_id, []).append(h.name)
    assert got == {
        1: ["Berg", "Bergen", "Bergfeld", "Bergheim", "Am Berg"],
        2: ["Zell", "Alt-" + long_name, long_name],
        4: [long_name, "Alt-" + long_name],
        6: ["Alt-" + long_name, long_name],
    }
    stored = search.search_index(places)
    assert [h.name for h in search.first_hit(queries, places, index=stored).orderBy("search_id").collect()] == [
        "Berg",
        "Zell",
        long_name,
        "Alt-" + long_name,
    ]


def test_a_stored_index_must_hold_enough_hits(spark, load):
    places = load("places")
    asked = spark.createDataFrame([(1, "supplier")], "search_id int, q string")
    stored = search.search_index(places, 8)
    want = search.geocode(asked, places, k=8)
    assert search.geocode(asked, places, k=8, index=stored).exceptAll(want).count() == 0 and want.count() == 8
    with pytest.raises(Exception, match="fewer than 9 hits"):
        search.geocode(asked, places, k=9, index=stored).collect()


def test_only_asked_texts_are_ranked(spark):
    start = "x" * 100
    rows = [(i, f"{start}{i:03d}", None, None, 10.0, 50.0) for i in range(60)]
    places = spark.createDataFrame(rows, "place_id bigint, name string, city string, country string, lon double, lat double")
    asked = spark.createDataFrame([(1, start + "007"), (2, start), (3, start + "x")], "search_id int, q string")
    got = [(r.search_id, r.place_id) for r in search.geocode(asked, places).orderBy("search_id", "position").collect()]
    assert got == [(1, 7), (2, 0), (2, 1), (2, 2), (2, 3), (2, 4)]
    plan = search.geocode(asked, places)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("LeftSemi")  # the semi join lies below


def test_search_keeps_k_rows_per_task_before_the_shuffle(load):
    plan = search.search_index(load("places"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_pyramid_store(spark, load, tmp_path):
    df = load("accidents")
    path = str(tmp_path / "layers")
    pyramid.write_pyramid(df, path, partitions=6)
    layer = scans.read_layer(spark, path, "accidents")
    plan = layer._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan
    assert layer.count() == 6000
    ids = layer.withColumn("f", F.input_file_name()).groupBy("f").agg(F.min("tile_id").alias("lo"), F.max("tile_id").alias("hi"))
    spans = sorted((r.lo, r.hi) for r in ids.collect())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_csv_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("OBJECTID;lon;lat\n1;8,5;50,25\n")
    one = scans.read_accidents_csv(spark, str(tmp_path)).collect()
    assert [(r.OBJECTID, r.lon, r.lat, r.UART) for r in one] == [(1, 8.5, 50.25, None)]
    (tmp_path / "b.csv").write_text("lat;lon;OBJECTID\n51;9;2\n")
    with pytest.raises(Exception, match="CSV header does not conform|INCOMPATIBLE|does not conform"):
        scans.read_accidents_csv(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="no column X"):
        scans.read_accidents_csv(spark, str(tmp_path / "a.csv"), coordinates=("X", "lat"))


def test_feature_collections(spark):
    one = '{"properties":{"place_id":1,"name":"A"},"geometry":{"coordinates":[8.0,50.0]}}'
    docs = spark.createDataFrame([(one,), ('{"features":[%s,%s]}' % (one, one.replace("1", "2")),), ('{"features":[]}',), (None,)], "value string")
    rows = [tuple(r)[:2] + (r.lon, r.lat) for r in scans.places_from_geojson(docs).where("place_id is not null").collect()]
    assert sorted(rows) == [(1, "A", 8.0, 50.0), (1, "A", 8.0, 50.0), (2, "A", 8.0, 50.0)]


def test_views_of_sessions_without_toggles(spark):
    from crashgrid.operators import sessions

    views = spark.createDataFrame([(1, 5), (2, 6)], "view_id int, session_id int")
    states = spark.createDataFrame([(5, 3)], "session_id int, mask bigint")
    rows = {r.view_id: r.mask for r in sessions.with_state(views, states).collect()}
    assert rows == {1: 3, 2: sum(model.legend_bits().values())}


def test_a_cluster_needs_a_shared_folder():
    from crashgrid.sources import storage

    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs:///tmp/x/"
    assert storage.shared_dir(Session()) == "hdfs:///tmp/x"


def test_pairs_are_not_shuffled(spark):
    """Views travel with groups of points; pairs appear behind the last exchange."""
    points = spark.range(20_000).selectExpr("id as OBJECTID", "13.4d + (id % 200) / 1e5 as lon", "52.5d + (id div 200) / 1e5 as lat")
    views = spark.range(300).selectExpr(
        "id as view_id", "13.4d + id / 1e6 as center_lon", "52.5d as center_lat", "12d as zoom", "1000 as width_px", "768 as height_px"
    )
    pairs = viewport.viewport_join(views, points, keep=["view_id"]).select("view_id", "OBJECTID")
    path = storage.new_path(spark, "pairs")
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway

    def shuffled():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = shuffled()
    pairs.write.parquet(path)
    assert spark.read.parquet(path).count() == 300 * 20_000
    assert shuffled() - before < 200_000
