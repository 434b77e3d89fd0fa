"""Attribute and area filters on accident points."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashgrid import model
from crashgrid.model import FilterState


def in_values(column: str, values: list[int]) -> Column | None:
    """Membership in the checked codes; no constraint when nothing is checked."""
    return F.col(column).isin(list(values)) if values else None


def any_flag(flags: list[str]) -> Column | None:
    """At least one of the checked participant flags is 1; no constraint when empty."""
    return reduce(or_, [F.col(f) == 1 for f in flags]) if flags else None


def accident_condition(state: FilterState) -> Column:
    """The combined condition of one filter state.

    When severity, kind, type and participants are all empty nothing is shown;
    the year boxes do not take part in that test.
    """
    if not (state.ukategorie or state.uart or state.utyp1 or state.flags):
        return F.lit(False)
    parts = [
        in_values("UKATEGORIE", state.ukategorie),
        in_values("UART", state.uart),
        in_values("UTYP1", state.utyp1),
        in_values("UJAHR", state.ujahr),
        any_flag(state.flags),
    ]
    return reduce(and_, [p for p in parts if p is not None])


def accident_filter(df: DataFrame, state: FilterState) -> DataFrame:
    """Accidents that pass one filter state; the predicates reach the Parquet scan."""
    return df.where(accident_condition(state))


def accident_boxes() -> Column:
    """Legend boxes an accident belongs to, one bit each; unknown codes have no bit."""
    bits = []
    for (grp, val), bit in model.legend_bits().items():
        hit = F.col(val) == 1 if grp == model.PARTICIPANT_GROUP else F.col(grp) == int(val)
        bits.append(F.when(hit, F.lit(bit)).otherwise(F.lit(0)).cast("bigint"))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def boxes_match(mask: Column, boxes: Column) -> Column:
    """``accident_condition`` for a filter state held as a bit mask in each row.

    ``mask`` has the checked boxes, ``boxes`` those of the accident.
    """

    def some(value: Column, groups: list[str]) -> Column:
        return value.bitwiseAND(sum(model.group_bits(g) for g in groups)) != 0

    deciding = [g for g in model.CODE_GROUPS if g != "UJAHR"] + [model.PARTICIPANT_GROUP]
    both = mask.bitwiseAND(boxes)
    groups = [~some(mask, [g]) | some(both, [g]) for g in [*model.CODE_GROUPS, model.PARTICIPANT_GROUP]]
    return some(mask, deciding) & reduce(and_, groups)


def in_bounds(minlon, minlat, maxlon, maxlat) -> Column:
    """Point inside the bounds, edges included."""
    return F.col("lon").between(minlon, maxlon) & F.col("lat").between(minlat, maxlat)


def in_viewport(df: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Points inside (minlon, minlat, maxlon, maxlat), edges included."""
    return df.where(in_bounds(*bounds))


def search_bbox(places: DataFrame) -> DataFrame:
    """Places inside the fixed search area."""
    return in_viewport(places, model.SEARCH_BBOX)


def min_query_length(q: Column, n: int = model.SEARCH_MIN_LENGTH) -> Column:
    return F.length(q) >= n


def in_archive_zoom(z: Column, minzoom: int, maxzoom: int) -> Column:
    return z.between(minzoom, maxzoom)
