"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrid.sources.storage import discard, materialise

MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """Per node ``u`` the least of itself and its neighbours ``v``, as ``m``."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _unfinished(edges: DataFrame) -> DataFrame:
    """Nodes of which ``edges`` (u above v) are no stars yet: with several least nodes, or both above and below.

    One aggregation with map-side combining, so a round has one exchange for it.
    """
    ends = F.explode(F.array(F.struct(F.col("u").alias("at"), F.lit(1).alias("up")), F.struct(F.col("v").alias("at"), F.lit(0).alias("up"))))
    sums = edges.select(ends.alias("end")).groupBy("end.at").agg(F.sum("end.up").alias("up"), F.min("end.up").alias("least"))
    return sums.where("up > 1 or (up = 1 and least = 0)")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b; no nulls): root is the least node.

    Each round first hangs the larger neighbours of a node on its least neighbour, then a
    node and its smaller neighbours on the least of them. Rounds are written to the shared
    folder and stop when the edges form stars. The number of rounds grows with the
    logarithm of the longest path.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialise(now, "edges")
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        small = large.join(_least(large), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        before, now = now, materialise(small.where("u != v").distinct(), "edges")
        discard(before)
        if _unfinished(now).isEmpty():
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                roots.select("node", F.col("node").alias("root"))
            )
    raise RuntimeError(f"components are not complete after {MAX_ROUNDS} rounds")
