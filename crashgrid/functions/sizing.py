"""Radius, size class and captions of clusters and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from crashgrid import model


def cluster_radius(count: Column, band: str = "fine") -> Column:
    """Radius interpolated linearly between the stops of a band, clamped at both ends."""
    stops = {"fine": model.FINE_RADIUS_STOPS, "coarse": model.COARSE_RADIUS_STOPS}[band]
    n = count.cast("double")
    radius = F.when(n <= stops[0][0], F.lit(float(stops[0][1])))
    for (n0, r0), (n1, r1) in zip(stops, stops[1:]):
        slope = (r1 - r0) / (n1 - n0)
        radius = radius.when(n <= n1, F.lit(float(r0)) + (n - F.lit(float(n0))) * F.lit(slope))
    return radius.when(n.isNotNull(), F.lit(float(stops[-1][1])))


def cluster_size_class(count: Column) -> Column:
    """Struct (label, dot_px) of the legend bucket; NULL below 1."""

    def pick(index: int) -> Column:
        descending = model.SIZE_CLASSES[::-1]
        first, rest = descending[0], descending[1:]
        return reduce(
            lambda acc, row: acc.when(count >= row[0], F.lit(row[index])),
            rest,
            F.when(count >= first[0], F.lit(first[index])),
        )

    return F.when(count >= 1, F.struct(pick(1).alias("label"), pick(2).alias("dot_px")))


def cluster_tooltip(count: Column) -> Column:
    """``<n> Unfälle``; NULL for a missing or zero count."""
    return F.when(count != 0, F.concat(count.cast("string"), F.lit(" Unfälle")))


def count_caption(n: Column, zoom: Column, clustered: Column) -> Column:
    """Two-line caption under the legend: visible points and zoom level."""
    head = F.when(clustered, F.lit("Sichtbare Punkte (Cluster): ")).otherwise("Sichtbare Punkte: ")
    return F.concat(head, F.format_number(n, 0), F.lit("\nZoomlevel: "), F.format_number(zoom, 2))
