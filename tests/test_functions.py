"""Golden values of the scalar functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crashgrid import model
from crashgrid.functions import codes, curve, geo, sizing, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "n, fine, coarse",
    [
        (0, 2, 2),
        (1, 2, 2),
        (10, 4, 4),
        (30, 5, 5),
        (750, 13, 13),
        (3000, 20, 20),
        (9000, 22, 24.25),
        (20000, 22, 26),
    ],
)
def test_cluster_radius(spark, n, fine, coarse):
    assert one(spark, sizing.cluster_radius(F.lit(n), "fine")) == pytest.approx(fine)
    assert one(spark, sizing.cluster_radius(F.lit(n), "coarse")) == pytest.approx(coarse)


def test_cluster_radius_of_null(spark):
    assert one(spark, sizing.cluster_radius(F.lit(None).cast("bigint"))) is None


@pytest.mark.parametrize(
    "n, label, px",
    [(1, "1 Unfall", 2), (9, "2–9 Unfälle", 4), (10, "10–49 Unfälle", 6), (16000, "16000+ Unfälle", 26)],
)
def test_size_class(spark, n, label, px):
    assert tuple(one(spark, sizing.cluster_size_class(F.lit(n)))) == (label, px)


def test_size_class_and_tooltip_of_nothing(spark):
    assert one(spark, sizing.cluster_size_class(F.lit(0))) is None
    assert one(spark, sizing.cluster_tooltip(F.lit(0))) is None
    assert one(spark, sizing.cluster_tooltip(F.lit(None).cast("int"))) is None
    assert one(spark, sizing.cluster_tooltip(F.lit(7))) == "7 Unfälle"


def test_caption(spark):
    caption = sizing.count_caption(F.lit(1234567), F.lit(11.0), F.lit(False))
    assert one(spark, caption) == "Sichtbare Punkte: 1,234,567\nZoomlevel: 11.00"
    caption = sizing.count_caption(F.lit(0), F.lit(8.254), F.lit(True))
    assert one(spark, caption) == "Sichtbare Punkte (Cluster): 0\nZoomlevel: 8.25"


def test_code_label(spark):
    rows = spark.createDataFrame([(5,), (0,), (42,), (None,)], "c int")
    got = [r.v for r in rows.select(codes.code_label("c", "UART").alias("v")).collect()]
    assert got == ["Einbiegend/kreuzend (5)", "Sonstiger Unfall (0)", "42", "?"]


FLAGS = "IstRad int, IstPKW int, IstFuss int, IstKrad int, IstGkfz int, IstSonstig int"


def test_participants(spark):
    rows = spark.createDataFrame([(1, 0, 0, None, 1, 2), (0, 0, 0, 0, 0, 0)], FLAGS)
    got = rows.select(
        codes.participant_letters().alias("l"),
        codes.participant_labels().alias("t"),
        codes.participant_color().alias("c"),
        codes.participant_letters(show=False).alias("h"),
    ).collect()
    assert tuple(got[0]) == ("R, G", "Fahrrad, Güterkraftfahrzeug (GKFZ)", "#1f78b4", None)
    assert tuple(got[1]) == ("", "", "#aaaaaa", None)


def test_legend_color(spark):
    assert one(spark, codes.legend_color(F.lit("UART"), F.lit("#123456"), F.lit("UART"))) == "#123456"
    assert one(spark, codes.legend_color(F.lit("UART"), F.lit("#123456"), F.lit("UJAHR"))) == "#ffffff"
    missing = F.lit(None).cast("string")
    assert one(spark, codes.legend_color(F.lit("UART"), missing, F.lit("UART"))) == "#aaaaaa"


@pytest.mark.parametrize("name, city, country, want", [
    ("Dom", "Köln", "DE", "Dom, Köln"),
    ("Dom", "", "DE", "Dom, DE"),
    ("Dom", None, None, "Dom, "),
    (None, "", "", ", "),
])
def test_place_label(spark, name, city, country, want):
    cols = [F.lit(v).cast("string") for v in (name, city, country)]
    assert one(spark, text.place_label(*cols)) == want


@pytest.mark.parametrize(
    "value, want", [("2017", 2017), (" 12abc", 12), ("-3", -3), ("x1", None), ("", None), ("99999999999", None)]
)
def test_parse_code(spark, value, want):
    assert one(spark, text.parse_code(F.lit(value))) == want


def test_image_link(spark):
    assert one(spark, text.image_link(F.lit(""))) is None
    assert one(spark, text.image_link(F.lit(None).cast("string"))) is None
    assert one(spark, text.image_link(F.lit("5"))).endswith("pKey=5&focus=photo")


def test_parse_tile_url(spark):
    url = "pmtiles://a/b/3/5/7/1/2"
    got = one(spark, geo.parse_tile_url(F.lit(url)))
    assert (got.archive, got.z, got.x, got.y) == ("a/b/3/5", 7, 1, 2)
    assert one(spark, geo.parse_tile_url(F.lit("http://x"))) is None


def test_default_view_bounds(spark):
    b = one(spark, geo.viewport_bounds(F.lit(0.0), F.lit(0.0), F.lit(0.0), 512, 512))
    assert (round(b.minlon, 6), round(b.maxlon, 6)) == (-180, 180)
    assert round(b.maxlat, 5) == round(geo.MAX_LAT, 5)


TILES = [
    (0, 0, 0, 0),
    (1, 0, 0, 1),
    (1, 0, 1, 2),
    (1, 1, 1, 3),
    (1, 1, 0, 4),
    (2, 3, 0, 20),
    (3, 5, 2, 76),
    (11, 1101, 673, 4966823),
    (12, 3423, 1763, 19078479),
    (26, 0, 0, 1501199875790165),
    (26, 2**26 - 1, 2**26 - 1, 4503599627370495),
]


def test_tile_id_golden(spark):
    df = spark.createDataFrame(TILES, "z int, x bigint, y bigint, id bigint")
    for r in curve.with_tile_id(df).collect():
        assert r.tile_id == r.id
    for r in curve.with_tile_zxy(df.select("id", F.struct("z", "x", "y").alias("t")), "id").collect():
        assert (r.z, r.x, r.y) == tuple(r.t)


def test_tile_id_out_of_range(spark):
    bad = spark.createDataFrame([(27, 0, 0), (3, 8, 0), (3, 0, 8), (3, -1, 0), (None, 0, 0)], "z int, x bigint, y bigint")
    assert [r.tile_id for r in curve.with_tile_id(bad).collect()] == [None] * 5
    with pytest.raises(Exception, match="outside"):
        curve.with_tile_id(bad.where("z = 27"), strict=True).collect()
    last = (4**27 - 1) // 3
    ids = spark.createDataFrame([(last - 1,), (last,), (-1,)], "tile_id bigint")
    got = curve.with_tile_zxy(ids).collect()
    assert (got[0].z, got[1].z, got[2].z) == (26, None, None)
    with pytest.raises(Exception, match="outside"):
        curve.with_tile_zxy(ids, strict=True).collect()


def test_tile_id_round_trip(spark):
    z = (F.col("id") % 27).cast("int")
    side = F.pow(F.lit(2.0), "z").cast("bigint")
    tiles = (
        spark.range(40000)
        .select("id", z.alias("z"))
        .select("z", F.pmod(F.xxhash64("id"), side).alias("x"), F.pmod(F.hash("id").cast("bigint"), side).alias("y"))
    )
    back = curve.with_tile_zxy(
        curve.with_tile_id(tiles).select("tile_id", F.struct("z", "x", "y").alias("t"))
    )
    assert back.where("z <> t.z or x <> t.x or y <> t.y or z is null").count() == 0
    # Neighbours on the curve are neighbours on the grid.
    steps = spark.range(1365, 5461).select(F.col("id").alias("tile_id"))
    rows = sorted((r.tile_id, r.x, r.y) for r in curve.with_tile_zxy(steps).collect())
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(rows, rows[1:]))


def hilbert_position(z, x, y):
    """Recursive definition of the curve, one quadrant at a time."""
    if z == 0:
        return 0
    half = 1 << (z - 1)
    qx, qy, x, y = x // half, y // half, x % half, y % half
    if (qx, qy) == (0, 0):
        return hilbert_position(z - 1, y, x)
    if (qx, qy) == (0, 1):
        return half * half + hilbert_position(z - 1, x, y)
    if (qx, qy) == (1, 1):
        return 2 * half * half + hilbert_position(z - 1, x, y)
    return 3 * half * half + hilbert_position(z - 1, half - 1 - y, half - 1 - x)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 26), st.integers(0, 2**26), st.integers(0, 2**26)), min_size=1))
def test_tile_id_against_definition(spark, raw):
    tiles = [(z, x % (1 << z), y % (1 << z)) for z, x, y in raw]
    df = spark.createDataFrame(tiles, "z int, x bigint, y bigint")
    for r in curve.with_tile_id(df).collect():
        assert r.tile_id == (4**r.z - 1) // 3 + hilbert_position(r.z, r.x, r.y)


def test_legend_is_complete():
    assert len(model.legend_rows()) == 33
    assert [v for g, v, *_ in model.legend_rows() if g == "UART"] == [*"1234567890"]
    assert len(set(model.legend_bits().values())) == 33
