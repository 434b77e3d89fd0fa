"""Place search: top hits per query, first hit per submitted query.

Names are found by an inverted index of their grams, the strings of one to three
characters in them. A text probes the gram of its own that the fewest names hold, and what
that posting list offers is checked against the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashgrid import model
from crashgrid.functions.text import place_label
from crashgrid.operators.filters import search_bbox
from crashgrid.operators.skew import dealt_anew, sized_join

GRAM = 3


def normalise(text: Column) -> Column:
    return F.lower(F.trim(text))


def _named(places: DataFrame) -> DataFrame:
    """Places of the search area with their normalised name in ``_n``."""
    return search_bbox(places).withColumn("_n", normalise(F.col("name"))).where(F.length("_n") > 0)


def _with_grams(df: DataFrame, text: str) -> DataFrame:
    """A row per distinct gram of ``text``; texts of up to GRAM characters give themselves, too.

    The characters are split off once, so the work is linear in the length.
    """
    lettered = df.withColumn("_letters", F.split(text, ""))

    def of_size(size: int) -> Column:
        starts = F.sequence(F.lit(0), F.size("_letters") - size)
        grams = F.transform(starts, lambda i: F.concat(*[F.get("_letters", i + j) for j in range(size)]))
        return F.when(F.size("_letters") >= size, grams).otherwise(F.array().cast("array<string>"))

    grams = F.array_distinct(F.flatten(F.array(*[of_size(size) for size in range(1, GRAM + 1)])))
    return lettered.withColumn("gram", F.explode(grams)).drop("_letters")


def _best(places: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The first k places of each key; each task keeps no more before the shuffle."""
    best = Window.partitionBy(key).orderBy(*order)
    return places.withColumn("position", F.row_number().over(best)).where(F.col("position") <= k)


def search_index(places: DataFrame, k: int = model.SEARCH_LIMIT) -> DataFrame:
    """Posting lists: a row per gram of a name and place (gram, _n, place columns, k).

    Of places with one name only the best k can be hits, so no more are kept. The index
    does not depend on the queries and grows with the length of the names; store it to
    serve many batches. Column ``k`` says how many hits it was made for.
    """
    named = _best(_named(places), "_n", ["name", "place_id"], k).drop("position")
    return _with_grams(named, "_n").withColumn("k", F.lit(k))


def _rarest(parts: DataFrame, postings: DataFrame) -> DataFrame:
    """The gram of each text that the fewest postings have (text, gram).

    Texts with a gram that no name has are left out.
    """
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    counted = sized_join(parts, dealt_anew(counts, ["gram"]), ["gram"], "left")
    least = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")
    return counted.groupBy("text").agg(least).where("least.n > 0").select("text", "least.gram")


def _hits_of(texts: DataFrame, index: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The best k places per distinct text: exact, prefix, contains, then name, then id.

    Posting lists that nobody asked for are dropped before anything is counted or ranked.
    """
    parts = _with_grams(texts, "text")
    asked = dealt_anew(parts.select("gram").distinct(), ["gram"])
    postings = sized_join(index, asked, ["gram"], "left_semi")
    probes = _rarest(parts, postings.select("gram"))
    found = sized_join(dealt_anew(postings, ["gram"]), probes, ["gram"]).where(F.contains("_n", "text"))
    match = F.when(F.col("_n") == F.col("text"), 0).when(F.startswith("_n", "text"), 1).otherwise(2)
    ranked = _best(found.withColumn("_match", match), "text", ["_match", "name", "place_id"], k)
    return ranked.select("text", "position", *columns)


def geocode(
    queries: DataFrame,
    places: DataFrame,
    q: str = "q",
    k: int = model.SEARCH_LIMIT,
    index: DataFrame | None = None,
) -> DataFrame:
    """Hits of every query, best first: (query columns, position, place columns, label).

    ``index`` is a stored ``search_index`` of the same places; reading it fails if it was
    made for fewer than k hits. Many users type the same text, so hits are found per text
    and then joined back; the few rows of a text are dealt anew before, so that a text
    that most users type is split over tasks.
    """
    asked = queries.withColumn("text", normalise(F.col(q))).where(F.col("text") != "")
    if index is None:
        index = search_index(places, k)
    else:
        message = F.lit(f"the stored index has fewer than {k} hits per text")
        index = index.where(F.when(F.col("k") < k, F.raise_error(message)).isNull())
    hits = _hits_of(asked.select("text").distinct(), index, places.columns, k)
    label = place_label(F.col("name"), F.col("city"), F.col("country"))
    return sized_join(asked, dealt_anew(hits, ["text"]), ["text"]).drop("text").withColumn("label", label)


def first_hit(
    queries: DataFrame, places: DataFrame, q: str = "q", index: DataFrame | None = None
) -> DataFrame:
    """The hit a submitted query jumps to; queries without a hit give no row."""
    return geocode(queries, places, q, 1, index)
