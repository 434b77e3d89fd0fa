"""Run-length tile tables: look-up, misses, compaction, expansion and summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashgrid import model
from crashgrid.functions import curve, geo
from crashgrid.operators.filters import in_archive_zoom
from crashgrid.operators.skew import dealt_anew, sized_join

#: Ids and runs are searched in buckets of 2^18 ids; tile ids have up to 53 bits.
LOOK_BITS, ID_BITS = 18, 53
#: Runs are expanded by way of blocks of these many ids, so no row holds a long array.
EXPAND_BITS = (40, 20)
COMPACT_BITS = (18, 36, 53)


def parse_requests(requests: DataFrame, url: str = "url") -> DataFrame:
    """Requests with archive, z, x, y, tile_id and a ``bad_url`` flag."""
    parsed = requests.withColumn("_p", geo.parse_tile_url(F.col(url)))
    cols = parsed.select(*requests.columns, "_p.*", F.col("_p").isNull().alias("bad_url"))
    return curve.with_tile_id(cols)


def _covering(asked: DataFrame, runs: DataFrame, level: int = 0) -> DataFrame:
    """``id, run`` for the distinct ids in ``asked`` that lie in a run (first, stop, run).

    Ids and runs are dealt by bucket of 2^18 ids, where a running last value finds the
    latest run that began at or before an id. A run that reaches into later buckets covers
    their first ids: as a run of bucket numbers it is carried there by the same search
    one level up, over the buckets asked for. A bucket never has more than 2^19 rows.
    """
    bucket = F.shiftright("at", LOOK_BITS).alias("bucket")
    begin = F.struct(F.col("stop"), F.col("run"))
    starts = runs.select(F.col("first").alias("at"), F.lit(0).alias("kind"), begin.alias("begin"))
    ids = asked.select(F.col("id").alias("at"), F.lit(1).alias("kind"), F.when(F.lit(False), F.lit(None)).cast(starts.schema["begin"].dataType).alias("begin"))
    both = starts.unionByName(ids).select("*", bucket)
    so_far = Window.partitionBy("bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = both.withColumn("last", F.last("begin", ignorenulls=True).over(so_far)).where("kind = 1")
    placed = latest.select(F.col("at").alias("id"), "bucket", F.when(F.col("last.stop") > F.col("at"), F.col("last.run")).alias("run"))
    if (level + 1) * LOOK_BITS >= ID_BITS:
        return placed.where("run is not null").select("id", "run")
    first, last = F.shiftright("first", LOOK_BITS), F.shiftright(F.col("stop") - 1, LOOK_BITS)
    crossing = runs.where(first < last).select((first + 1).alias("first"), (last + 1).alias("stop"), begin.alias("run"))
    buckets = asked.select(F.shiftright("id", LOOK_BITS).alias("id")).distinct()
    carried = _covering(buckets, crossing, level + 1).withColumnsRenamed({"id": "bucket", "run": "carried"})
    found = sized_join(placed, carried, ["bucket"], "left")
    reached = F.when(F.col("carried.stop") > F.col("id"), F.col("carried.run"))
    return found.select("id", F.coalesce("run", reached).alias("run")).where("run is not null")


def tile_lookup(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requests joined with the run that covers their tile id; unresolved ones drop out.

    ``entries`` are runs that do not overlap, so the run with the greatest start at or before
    the id is the only candidate. Every asked id is searched once, and its run is dealt anew
    to the requests, so that an id that most requests ask for is split over tasks.
    """
    names = {c: "run_start" if c == "tile_id" else c for c in entries.columns}
    run = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).alias("run")
    data = entries.where(F.col("tile_id").isNotNull() & (F.col("run_length") > 0))
    runs = data.select(F.col("tile_id").alias("first"), (F.col("tile_id") + F.col("run_length")).alias("stop"), run)
    asked = requests.where(F.col("tile_id").isNotNull()).select(F.col("tile_id").alias("id")).distinct()
    found = _covering(asked, runs).withColumnRenamed("id", "tile_id")
    hits = sized_join(requests.withColumn("_request", F.struct(*requests.columns)).select("tile_id", "_request"), dealt_anew(found, ["tile_id"]), ["tile_id"])
    return hits.select("_request.*", "run.*")


def missing_tiles(requests: DataFrame, entries: DataFrame, strict: bool = False) -> DataFrame:
    """Requests that ``tile_lookup`` does not resolve; ``strict`` raises on the first one.

    Every asked tile id is looked up once, and requests without a resolved id remain.
    """
    asked = requests.where(F.col("tile_id").isNotNull()).select("tile_id").distinct()
    found = tile_lookup(asked, entries.select("tile_id", "run_length")).select("tile_id")
    left = sized_join(requests, found, ["tile_id"], "left_anti").select(*requests.columns)
    if strict:
        message = F.concat(F.lit("tile not found: "), F.col("tile_id").cast("string"))
        left = left.where(F.raise_error(message).isNull())
    return left


def resolve_urls(
    requests: DataFrame, entries: DataFrame, minzoom: int, maxzoom: int
) -> DataFrame:
    """URL requests resolved to their run; zooms outside the archive give no result."""
    inside = parse_requests(requests).where(in_archive_zoom(F.col("z"), minzoom, maxzoom))
    return tile_lookup(inside, entries)


def _blocks(runs: DataFrame, bits: int) -> DataFrame:
    """Runs cut at multiples of 2^bits."""
    last = F.col("tile_id") + F.col("run_length") - 1
    blocks = F.sequence(F.shiftright("tile_id", bits), F.shiftright(last, bits))
    cut = runs.withColumn("_end", last + 1).withColumn("_b", F.explode(blocks))
    low = F.greatest(F.col("tile_id"), F.shiftleft("_b", bits))
    high = F.least(F.col("_end"), F.shiftleft(F.col("_b") + 1, bits))
    rest = [c for c in runs.columns if c not in ("tile_id", "run_length")]
    return cut.select(low.alias("tile_id"), (high - low).alias("run_length"), *rest)


def expand_blocks(entries: DataFrame) -> DataFrame:
    """Runs of any length as runs of at most 2^20 tiles."""
    runs = entries.where(F.col("run_length") > 0)
    for bits in EXPAND_BITS:
        runs = _blocks(runs, bits)
    return runs


def expand_runs(entries: DataFrame) -> DataFrame:
    """One row per tile of every run."""
    ids = F.sequence(F.col("tile_id"), F.col("tile_id") + F.col("run_length") - 1)
    rest = [c for c in entries.columns if c not in ("tile_id", "run_length")]
    return expand_blocks(entries).select(F.explode(ids).alias("tile_id"), *rest)


def _merge_runs(runs: DataFrame, bits: int) -> DataFrame:
    ordered = Window.partitionBy("bucket").orderBy("tile_id")
    previous_end = F.lag(F.col("tile_id") + F.col("run_length")).over(ordered)
    continues = (previous_end == F.col("tile_id")) & F.lag("content").over(ordered).eqNullSafe(
        F.col("content")
    )
    starts = F.when(continues, 0).otherwise(1)
    merged = (
        runs.withColumn("bucket", F.shiftright("tile_id", bits))
        .withColumn("starts", starts)
        .withColumn("island", F.sum("starts").over(ordered))
        .groupBy("bucket", "island")
        .agg(
            F.min("tile_id").alias("tile_id"),
            F.sum("run_length").alias("run_length"),
            F.first("content").alias("content"),
        )
    )
    return merged.select("tile_id", "run_length", "content")


def compact_runs(tiles: DataFrame) -> DataFrame:
    """Consecutive tile ids with equal content as runs (tile_id, run_length, content).

    Tiles are merged inside buckets of consecutive ids, never per content, so a
    content shared by most tiles is no hot group. Runs that touch a bucket edge are
    merged again in wider buckets; every bucket sees at most 2^19 rows.
    """
    runs = tiles.select("tile_id", F.lit(1).cast("bigint").alias("run_length"), "content")
    done = []
    for bits in COMPACT_BITS:
        runs = _merge_runs(runs, bits)
        if bits == COMPACT_BITS[-1]:
            break
        size = 1 << bits
        end = F.col("tile_id") + F.col("run_length")
        touches = (F.col("tile_id") % size == 0) | (end % size == 0)
        done.append(runs.where(~touches))
        runs = runs.where(touches)
    return reduce(DataFrame.unionByName, [*done, runs])


def tileset_summary(
    entries: DataFrame, points: DataFrame, content: str = "data_offset", exact: bool = True
) -> DataFrame:
    """One row of header counters: tiles, entries, contents, zoom range, bounds, centre."""
    distinct = F.count_distinct(content) if exact else F.approx_count_distinct(content)
    counters = entries.where(F.col("run_length") > 0).agg(
        F.sum("run_length").alias("addressed_tiles"),
        F.count("*").alias("tile_entries"),
        distinct.alias("tile_contents"),
        F.min("tile_id").alias("_first"),
        F.max(F.col("tile_id") + F.col("run_length") - 1).alias("_last"),
    )
    area = points.agg(
        F.min("lon").alias("minlon"),
        F.min("lat").alias("minlat"),
        F.max("lon").alias("maxlon"),
        F.max("lat").alias("maxlat"),
    )
    minzoom = curve.tile_zoom(F.col("_first"))
    both = counters.unionByName(area, allowMissingColumns=True)
    row = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return row.select(
        "addressed_tiles",
        "tile_entries",
        "tile_contents",
        minzoom.alias("minzoom"),
        curve.tile_zoom(F.col("_last")).alias("maxzoom"),
        "minlon",
        "minlat",
        "maxlon",
        "maxlat",
        ((F.col("minlon") + F.col("maxlon")) / 2).alias("center_lon"),
        ((F.col("minlat") + F.col("maxlat")) / 2).alias("center_lat"),
        minzoom.alias("center_zoom"),
    )


def tilejson(
    summary: DataFrame,
    base_url: str,
    tile_type: int,
    fields: DataFrame | None = None,
    metadata: dict[str, str] | None = None,
) -> DataFrame:
    """The summary as one TileJSON-shaped struct column.

    ``fields`` comes from ``layer_fields`` (layer, fields) and becomes ``vector_layers``,
    with the zoom range of the set. ``metadata`` may give name, description, attribution
    and version.
    """
    ext = model.TILE_TYPE_EXTENSIONS.get(tile_type, "")
    texts = [F.lit((metadata or {}).get(k)).cast("string").alias(k) for k in ("name", "description", "attribution", "version")]
    layer = "array<struct<id:string,fields:array<string>>>"
    if fields is None:
        joined = summary.withColumn("_layers", F.array().cast(layer))
    else:
        every = fields.agg(
            F.sort_array(F.collect_list(F.struct(F.col("layer").alias("id"), "fields"))).alias("_layers")
        )
        # Two single rows become one without a join.
        both = summary.unionByName(every, allowMissingColumns=True)
        joined = both.agg(*[F.max(c).alias(c) for c in both.columns])
    vector_layers = F.transform("_layers", lambda x: F.struct(x["id"].alias("id"), x["fields"].alias("fields"), F.col("minzoom").alias("minzoom"), F.col("maxzoom").alias("maxzoom")))
    return joined.select(
        F.struct(
            F.lit("3.0.0").alias("tilejson"),
            F.lit("xyz").alias("scheme"),
            F.array(F.lit(f"{base_url}/{{z}}/{{x}}/{{y}}{ext}")).alias("tiles"),
            F.array("minlon", "minlat", "maxlon", "maxlat").alias("bounds"),
            F.array("center_lon", "center_lat", F.col("center_zoom").cast("double")).alias("center"),
            "minzoom",
            "maxzoom",
            vector_layers.alias("vector_layers"),
            *texts,
        ).alias("tilejson")
    )
