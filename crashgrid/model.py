"""Schemas and the fixed code, colour and legend values of the accident data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- Schemas -----------------------------------------------------------------

ACCIDENT = T.StructType(
    [
        T.StructField("OBJECTID", T.LongType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("UKATEGORIE", T.IntegerType()),
        T.StructField("UJAHR", T.IntegerType()),
        T.StructField("UART", T.IntegerType()),
        T.StructField("UTYP1", T.IntegerType()),
        T.StructField("IstRad", T.IntegerType()),
        T.StructField("IstPKW", T.IntegerType()),
        T.StructField("IstFuss", T.IntegerType()),
        T.StructField("IstKrad", T.IntegerType()),
        T.StructField("IstGkfz", T.IntegerType()),
        T.StructField("IstSonstig", T.IntegerType()),
    ]
)

IMAGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
    ]
)

PLACE = T.StructType(
    [
        T.StructField("place_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
    ]
)

TILE_ENTRY = T.StructType(
    [
        T.StructField("tile_id", T.LongType()),
        T.StructField("run_length", T.LongType()),
        T.StructField("data_offset", T.LongType()),
        T.StructField("data_length", T.LongType()),
    ]
)

# --- Fixed values: codes, labels, colours (in legend order) -------------------

SEVERITY_LABELS = {1: "Getötete", 2: "Schwerverletzte", 3: "Leichtverletzte"}
SEVERITY_COLORS = {1: "#e41a1c", 2: "#377eb8", 3: "#4daf4a"}

YEAR_COLORS = {
    2017: "#f7fbff",
    2018: "#deebf7",
    2019: "#c6dbef",
    2020: "#9ecae1",
    2021: "#6baed6",
    2022: "#4292c6",
    2023: "#2171b5",
}

KIND_LABELS = {
    1: "Anfahrend/ruhend",
    2: "Vorausfahrend/wartend",
    3: "Seitlich gleiche Richtung",
    4: "Entgegenkommend",
    5: "Einbiegend/kreuzend",
    6: "Fußgänger",
    7: "Fahrbahnhindernis",
    8: "Abkommen rechts",
    9: "Abkommen links",
    0: "Sonstiger Unfall",
}
KIND_COLORS = {
    1: "#1b9e77",
    2: "#d95f02",
    3: "#7570b3",
    4: "#e7298a",
    5: "#66a61e",
    6: "#e6ab02",
    7: "#a6761d",
    8: "#666666",
    9: "#1f78b4",
    0: "#bbbbbb",
}

TYPE_LABELS = {
    1: "Fahrunfall",
    2: "Abbiegeunfall",
    3: "Einbiegen/Kreuzen",
    4: "Fußgänger (Überschreiten)",
    5: "Ruhender Verkehr",
    6: "Längsverkehr",
    7: "Sonstiger Unfall",
}
TYPE_COLORS = {
    1: "#8dd3c7",
    2: "#ffffb3",
    3: "#bebada",
    4: "#fb8072",
    5: "#80b1d3",
    6: "#fdb462",
    7: "#b3de69",
}

PARTICIPANT_LABELS = {
    "IstRad": "Fahrrad",
    "IstPKW": "Pkw",
    "IstFuss": "Fußgänger",
    "IstKrad": "Kraftrad",
    "IstGkfz": "Güterkraftfahrzeug (GKFZ)",
    "IstSonstig": "Sonstige",
}
PARTICIPANT_LETTERS = {
    "IstRad": "R",
    "IstPKW": "P",
    "IstFuss": "F",
    "IstKrad": "K",
    "IstGkfz": "G",
    "IstSonstig": "S",
}
PARTICIPANT_COLORS = {
    "IstRad": "#1f78b4",
    "IstPKW": "#33a02c",
    "IstFuss": "#e31a1c",
    "IstKrad": "#ff7f00",
    "IstGkfz": "#a65628",
    "IstSonstig": "#6a3d9a",
}

DETAIL_LABELS = {
    "OBJECTID": "Unfall-ID",
    "UKATEGORIE": "Schwere",
    "UJAHR": "Jahr",
    "UART": "Unfallart",
    "UTYP1": "Unfalltyp",
}
PARTICIPANTS_DETAIL_LABEL = "Beteiligung"

DEFAULT_COLOR = "#aaaaaa"
INACTIVE_COLOR = "#ffffff"

# Radius stops (point_count -> radius) and the size legend
# (lower bound, label, dot px). The two differ on purpose: 8000 and 16000 share
# one dot size in the legend while the radius keeps growing.
FINE_RADIUS_STOPS = [
    (1, 2),
    (10, 4),
    (50, 6),
    (100, 8),
    (200, 10),
    (500, 12),
    (1000, 14),
    (2000, 18),
    (4000, 22),
]
COARSE_RADIUS_STOPS = FINE_RADIUS_STOPS + [(8000, 24), (16000, 26)]
SIZE_CLASSES = [
    (1, "1 Unfall", 2),
    (2, "2–9 Unfälle", 4),
    (10, "10–49 Unfälle", 6),
    (50, "50–99 Unfälle", 8),
    (100, "100–199 Unfälle", 10),
    (200, "200–499 Unfälle", 12),
    (500, "500–999 Unfälle", 14),
    (1000, "1000–1999 Unfälle", 18),
    (2000, "2000–3999 Unfälle", 22),
    (4000, "4000–7999 Unfälle", 24),
    (8000, "8000–15999 Unfälle", 26),
    (16000, "16000+ Unfälle", 26),
]

# Tile type and compression codes.
TILE_TYPE_NAMES = {0: "Unknown", 1: "Mvt", 2: "Png", 3: "Jpeg", 4: "Webp", 5: "Avif"}
TILE_TYPE_EXTENSIONS = {1: ".mvt", 2: ".png", 3: ".jpg", 4: ".webp", 5: ".avif"}
TILE_TYPE_MIMES = {2: "image/png", 3: "image/jpeg", 4: "image/webp", 5: "image/avif"}
COMPRESSION_NAMES = {0: "Unknown", 1: "None", 2: "Gzip", 3: "Brotli", 4: "Zstd"}

# URL formats, search box, zoom limits.
TILE_URL_PATTERN = r"pmtiles://(.+)/(\d+)/(\d+)/(\d+)"
IMAGE_LINK_PREFIX = "https://www.mapillary.com/app/?pKey="
IMAGE_LINK_SUFFIX = "&focus=photo"
SEARCH_BBOX = (5.0, 47.0, 15.0, 55.0)
SEARCH_LIMIT = 5
SEARCH_MIN_LENGTH = 2
SEARCH_DEBOUNCE = "250 milliseconds"
HIT_ZOOM = 15.0
CLUSTER_ZOOM_LIMIT = 11.0
ZOOM_RANGE = (6.0, 20.0)
IMAGE_ZOOM_RANGE = (14.0, 14.99)
MAX_TILE_ZOOM = 26
PICK_RADIUS_PX = 6.5

# Layer registry
# (layer_id, source, source_layer, minzoom, maxzoom, visible at load); None: no limit.
LAYERS = [
    ("clusters-coarse-layer", "accidents-cluster", "clusters_6_8", 6.0, 9.0, True),
    ("clusters-fine-layer", "accidents-cluster", "clusters_9_11", 9.0, 11.0, True),
    ("accident-points-11-12", "accidents_11-12", "accidents", 11.0, 12.0, True),
    ("accident-points-12-13", "accidents_12-13", "accidents", 12.0, 20.1, True),
    ("beteiligung-symbols-11-12", "accidents_11-12", "accidents", 11.0, 12.0, False),
    ("beteiligung-symbols-12-13", "accidents_12-13", "accidents", 12.0, 20.1, False),
    ("satellite-layer", "satellite", None, None, None, False),
    ("mapillary-images-layer", "mapillary-images", "image", 14.0, None, False),
]
# (source, deepest zoom with tiles of its own): beyond it the deepest tiles are shown again.
SOURCE_MAXZOOM = {"mapillary-images": 14.99}
COARSE_LAYER = "clusters_6_8"
FINE_LAYER = "clusters_9_11"
# (source, zoom whose tiles hold its points)
POINT_BANDS = [("accidents_11-12", 11), ("accidents_12-13", 12)]

# --- Derived from the above ----------------------------------------------------

PARTICIPANTS = list(PARTICIPANT_LABELS)
CODE_GROUPS = ["UKATEGORIE", "UART", "UTYP1", "UJAHR"]
PARTICIPANT_GROUP = "BETEILIGUNG"
CODE_LABELS = {"UKATEGORIE": SEVERITY_LABELS, "UART": KIND_LABELS, "UTYP1": TYPE_LABELS}
CODE_COLORS = {
    "UKATEGORIE": SEVERITY_COLORS,
    "UJAHR": YEAR_COLORS,
    "UART": KIND_COLORS,
    "UTYP1": TYPE_COLORS,
}


def legend_rows() -> list[tuple[str, str, str, str, int]]:
    """(grp, val, label, colour, position) for every legend box, in legend order."""
    rows = []
    for grp in ["UKATEGORIE", PARTICIPANT_GROUP, "UJAHR", "UTYP1", "UART"]:
        if grp == PARTICIPANT_GROUP:
            entries = [(f, PARTICIPANT_LABELS[f], PARTICIPANT_COLORS[f]) for f in PARTICIPANTS]
        else:
            labels = CODE_LABELS.get(grp, {})
            entries = [(str(c), labels.get(c, str(c)), rgb) for c, rgb in CODE_COLORS[grp].items()]
        rows += [(grp, v, label, rgb, i) for i, (v, label, rgb) in enumerate(entries, 1)]
    return rows


def legend_bits() -> dict[tuple[str, str], int]:
    """One bit per legend box, so a whole filter state fits in a BIGINT."""
    return {(grp, val): 1 << i for i, (grp, val, *_) in enumerate(legend_rows())}


def group_bits(grp: str) -> int:
    """All bits of one legend group."""
    return sum(bit for (g, _), bit in legend_bits().items() if g == grp)


@dataclass(frozen=True)
class FilterState:
    """Checked boxes of one view. Empty lists mean nothing is checked in that group."""

    ukategorie: list[int] = field(default_factory=list)
    uart: list[int] = field(default_factory=list)
    utyp1: list[int] = field(default_factory=list)
    ujahr: list[int] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)

    @classmethod
    def all_checked(cls) -> FilterState:
        """The state at load: every box is checked."""
        return cls(
            list(SEVERITY_COLORS),
            list(KIND_COLORS),
            list(TYPE_COLORS),
            list(YEAR_COLORS),
            list(PARTICIPANTS),
        )
