"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sized_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Sort-merge join for sides whose size Spark underestimates before it runs.

    An exploded side is estimated at the size of its input and would be broadcast
    too readily. Sort-merge spills, and adaptive execution splits the partitions of hot
    keys by the tasks that wrote them (both sides of an inner join, the left side of the
    others), whatever the rows look like and without counting keys first.
    """
    return left.join(right.hint("merge"), keys, how)


def dealt_anew(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with key columns that Spark takes for new ones.

    The result of an aggregate, window or join on the keys is already dealt by them. A join
    on the same keys would use it as it is, without an exchange on that side, and adaptive
    execution splits hot keys only where both sides have one. The one-element explode
    hides where the keys come from, at the price of one more exchange of this side.
    """
    hidden = df.withColumn("_keys", F.explode(F.array(F.struct(*keys))))
    return hidden.select(*[F.col(f"_keys.{c}").alias(c) if c in keys else F.col(c) for c in df.columns])
