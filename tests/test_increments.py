"""The growing layer store: old and new equal a full build, only touched zones are rewritten."""

import pytest
from pyspark.sql import functions as F

from crashgrid.operators import clusters as cl
from crashgrid.sources import increments, storage

POINTS = "OBJECTID bigint, UJAHR int, lon double, lat double"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def years(spark):
    rows = [(i, 2021 + i % 3, 6.0 + (i * 37 % 900) / 100, 47.5 + (i * 53 % 700) / 100) for i in range(600)]
    rows += [(1000, 2021, None, 50.0), (1001, 2023, 8.0, None)]
    return spark.createDataFrame(rows, POINTS)


def test_years_one_by_one_equal_all_at_once(spark, years, tmp_path):
    path = str(tmp_path / "store")
    for n, year in enumerate((2021, 2022, 2023)):
        assert increments.add(years.where(F.col("UJAHR") == year), path) == n
    want = cl.cluster_pyramid(years)
    assert rows_of(increments.read_clusters(spark, path)) == rows_of(want.select("zoom", "cx", "cy", "lon", "lat", "point_count"))
    for name in ("accidents_11-12", "accidents_12-13"):
        band = increments.read_points(spark, path, name)
        assert band.count() == 600
        assert all((r.inversions, r.overlaps) == (0, 0) for r in increments.order_of(band).collect())


def test_only_touched_zones_are_rewritten(spark, years, tmp_path):
    path = str(tmp_path / "store")
    increments.add(years, path)
    one = spark.createDataFrame([(5000, 2024, 8.0, 50.0), (5001, 2024, 8.0, 50.0)], POINTS)
    increments.add(one, path)
    zones = storage.names_in(spark, f"{path}/cells/version=1")
    assert len([z for z in zones if z.startswith("zone=")]) == 1
    total = increments.read_clusters(spark, path).where("zoom = 8").agg(F.sum("point_count")).first()[0]
    assert total == 602


def test_a_failed_addition_is_not_seen_and_can_be_repeated(spark, years, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    increments.add(years.where("UJAHR = 2021"), path)
    before = rows_of(increments.read_clusters(spark, path))
    new = years.where("UJAHR <> 2021")
    with monkeypatch.context() as patch:
        patch.setattr(storage, "discard", lambda *t: None)
        patch.setattr(increments, "_MANIFEST", "not a schema")
        patch.setattr(increments, "_manifest", lambda *a: {})
        with pytest.raises(Exception):
            increments.add(new, path)
    assert increments.last_version(spark, path) == 0
    assert rows_of(increments.read_clusters(spark, path)) == before
    assert increments.read_points(spark, path, "accidents_11-12").count() == 200
    increments.add(new, path)
    assert rows_of(increments.read_clusters(spark, path)) == rows_of(cl.cluster_pyramid(years).select("zoom", "cx", "cy", "lon", "lat", "point_count"))
    assert increments.read_points(spark, path, "accidents_11-12").count() == 600


def test_nothing_added(spark, years, tmp_path):
    path = str(tmp_path / "store")
    assert increments.last_version(spark, path) == -1
    assert increments.read_clusters(spark, path).count() == 0
    increments.add(years.where("false"), path)
    assert increments.read_clusters(spark, path).count() == 0
    increments.add(years, path)
    assert increments.read_clusters(spark, path).where("zoom = 6").agg(F.sum("point_count")).first()[0] == 600


def test_an_unsorted_layer_is_noticed(spark, tmp_path):
    path = str(tmp_path / "layer")
    ids = spark.createDataFrame([(5,), (3,), (4,), (9,)], "tile_id bigint").withColumns({"layer": F.lit("a"), "version": F.lit(0)})
    ids.coalesce(1).write.parquet(path)
    ids.coalesce(1).write.mode("append").parquet(path)
    found = increments.order_of(spark.read.parquet(path)).first()
    assert (found.rows, found.inversions, found.overlaps) == (8, 2, 1)
