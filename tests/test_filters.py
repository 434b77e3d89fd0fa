"""Filter rules, both for one state and for a mask per row."""

import itertools

from pyspark.sql import functions as F

from crashgrid.model import FilterState, group_bits, legend_bits
from crashgrid.operators import details, filters, layers
from crashgrid.sources import scans


def count(df, state):
    return filters.accident_filter(df, state).count()


def test_golden_counts(load):
    df = load("accidents")
    state = FilterState(ukategorie=[1, 2], ujahr=[2021, 2022, 2023], flags=["IstRad", "IstFuss"])
    assert df.count() == 6000
    assert count(df, state) == 214
    assert count(df, FilterState.all_checked()) == 5179


def test_years_do_not_count_as_a_selection(load):
    df = load("accidents")
    assert count(df, FilterState()) == 0
    assert count(df, FilterState(ujahr=[2020])) == 0
    assert count(df, FilterState(ukategorie=[1, 2, 3])) == 6000


def test_predicates_reach_the_scan(spark, load, tmp_path):
    path = str(tmp_path / "accidents")
    load("accidents").write.parquet(path)
    state = FilterState(ukategorie=[1], ujahr=[2021], flags=["IstRad"])
    df = filters.accident_filter(scans.read_accidents(spark, path), state).select("OBJECTID")
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    pushed = scan.split("PushedFilters")[1]
    assert "UKATEGORIE" in pushed and "UJAHR" in pushed
    assert "lat" not in scan.split("ReadSchema")[1]
    # Nothing selected folds to an empty relation without reading anything.
    empty = filters.accident_filter(scans.read_accidents(spark, path), FilterState())
    assert "FileScan" not in empty._jdf.queryExecution().executedPlan().toString()


def test_mask_equals_single_state(load):
    df = load("accidents")
    bits = legend_bits()
    groups = {
        "ukategorie": ("UKATEGORIE", [[], [1], [2, 3]]),
        "uart": ("UART", [[], [0, 5]]),
        "utyp1": ("UTYP1", [[], [1, 2, 3, 4, 5, 6, 7]]),
        "ujahr": ("UJAHR", [[], [2019, 2023]]),
        "flags": ("BETEILIGUNG", [[], ["IstGkfz"]]),
    }
    names, singles, masks = list(groups), [], []
    for choice in itertools.product(*[groups[n][1] for n in names]):
        picked = dict(zip(names, choice))
        mask = sum(bits[groups[n][0], str(v)] for n in names for v in picked[n])
        singles.append(F.count_if(filters.accident_condition(FilterState(**picked))))
        masks.append(F.count_if(filters.boxes_match(F.lit(mask).cast("bigint"), F.col("boxes"))))
    df = df.withColumn("boxes", filters.accident_boxes()).cache()
    assert tuple(df.agg(*singles).first()) == tuple(df.agg(*masks).first())
    assert sum(group_bits(g) for g in ("UKATEGORIE", "UART", "UTYP1", "UJAHR", "BETEILIGUNG")) == 2**33 - 1


def test_details_of_a_row_without_participants(spark, load):
    df = load("accidents")
    none = df.where("not (IstRad=1 or IstPKW=1 or IstFuss=1 or IstKrad=1 or coalesce(IstGkfz,0)=1 or IstSonstig=1)")
    assert details.detail_rows(none).where("label = 'Beteiligung'").count() == 0
    assert details.detail_rows(df).where("label = 'Beteiligung'").count() == 6000 - 656


def test_layers(spark):
    registry = layers.layer_registry(spark)
    assert registry.count() == 8
    zooms = spark.createDataFrame([(6.0,), (9.0,), (11.0,), (20.0,), (20.1,), (5.9,)], "zoom double")
    got = {(r.zoom, r.layer_id) for r in layers.visible_layers(zooms).collect()}
    assert got == {
        (6.0, "clusters-coarse-layer"),
        (9.0, "clusters-fine-layer"),
        (11.0, "accident-points-11-12"),
        (20.0, "accident-points-12-13"),
    }
    lettered = layers.visible_layers(zooms, toggles={"beteiligung-symbols-12-13": True})
    assert (20.0, "beteiligung-symbols-12-13") in {(r.zoom, r.layer_id) for r in lettered.collect()}


def test_csv_scan(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        "UJAHR;OBJECTID;lon;lat;UKATEGORIE;UART;UTYP1;IstRad;IstPKW;IstFuss;IstKrad;IstGkfz;IstSonstig;EXTRA\n"
        "2021;7;13,5;52.25;1;x;3;1;0;0;0;;0;z\n"
    )
    row = scans.read_accidents_csv(spark, str(path)).first()
    assert (row.OBJECTID, row.lon, row.lat, row.UJAHR) == (7, 13.5, 52.25, 2021)
    assert row.UART is None and row.IstGkfz is None and row.IstRad == 1


def test_geojson_places(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(
        '{"type":"Feature","properties":{"place_id":3,"name":"Ulm","country":"DE"},'
        '"geometry":{"type":"Point","coordinates":[9.99,48.4]}}\n'
    )
    row = scans.read_places_geojson(spark, str(path)).first()
    assert (row.place_id, row.name, row.city, row.country, row.lon, row.lat) == (3, "Ulm", None, "DE", 9.99, 48.4)


def test_parquet_scans(spark, load, tmp_path):
    for name, read in [("places", scans.read_places), ("images", scans.read_images)]:
        path = str(tmp_path / name)
        load(name).write.parquet(path)
        assert read(spark, path).count() == load(name).count()
    (tmp_path / "log.txt").write_text("pmtiles://a/1/0/1\n")
    assert scans.read_tile_requests(spark, str(tmp_path / "log.txt")).first().url == "pmtiles://a/1/0/1"
