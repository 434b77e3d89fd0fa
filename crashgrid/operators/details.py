"""Decoded and unpivoted accident rows, and the legend with its counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashgrid import model
from crashgrid.functions.codes import code_label, legend_color, participant_labels


def dimension(spark: SparkSession, grp: str) -> DataFrame:
    """Code dimension (code, label, color, position) of one group, in legend order."""
    rows = [(int(v), label, rgb, i) for g, v, label, rgb, i in model.legend_rows() if g == grp]
    return spark.createDataFrame(rows, "code int, label string, color string, position int")


def decode_codes(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Left join of every code dimension; adds ``<group>_label`` and ``<group>_color``.

    The dimensions are fixed (ten rows at most), so broadcasting them is safe.
    Unknown and NULL codes keep their row with a NULL label and the default colour.
    """
    for grp in groups or model.CODE_GROUPS:
        dim = dimension(df.sparkSession, grp).select(
            F.col("code").alias(grp),
            F.col("label").alias(f"{grp}_label"),
            F.col("color").alias(f"{grp}_color"),
        )
        df = df.join(F.broadcast(dim), grp, "left").fillna(
            model.DEFAULT_COLOR, subset=[f"{grp}_color"]
        )
    return df


def detail_rows(df: DataFrame) -> DataFrame:
    """One row per shown attribute of an accident: (OBJECTID, position, label, value).

    The participants row exists only for accidents with a participant flag set.
    """
    shown = [
        F.struct(F.lit(label).alias("label"), code_label(key, key).alias("value"))
        for key, label in model.DETAIL_LABELS.items()
    ]
    involved = F.nullif(participant_labels(), F.lit(""))
    last = F.struct(F.lit(model.PARTICIPANTS_DETAIL_LABEL).alias("label"), involved.alias("value"))
    rows = F.array(*shown, last)
    return (
        df.select("OBJECTID", F.posexplode(rows).alias("position", "row"))
        .where(F.col("row.value").isNotNull())
        .select("OBJECTID", "position", "row.label", "row.value")
    )


def legend(spark: SparkSession) -> DataFrame:
    """The legend boxes (grp, val, label, color, position)."""
    return spark.createDataFrame(
        model.legend_rows(), "grp string, val string, label string, color string, position int"
    )


def legend_counts(df: DataFrame, active: str) -> DataFrame:
    """Legend boxes with their swatch colour for one colouring key and accident counts.

    One pass over the accidents counts every box at once; no shuffle grows with
    the data because each task sends a single row of counters.
    """
    boxes = model.legend_rows()

    def hit(grp: str, val: str):
        return F.col(val) == 1 if grp == model.PARTICIPANT_GROUP else F.col(grp) == int(val)

    counters = [F.count_if(hit(g, v)).alias(f"_{i}") for i, (g, v, *_) in enumerate(boxes)]
    entries = [
        F.struct(
            F.lit(g).alias("grp"),
            F.lit(v).alias("val"),
            F.lit(label).alias("label"),
            F.lit(rgb).alias("color"),
            F.lit(pos).alias("position"),
            F.col(f"_{i}").alias("accidents"),
        )
        for i, (g, v, label, rgb, pos) in enumerate(boxes)
    ]
    rows = df.agg(*counters).select(F.explode(F.array(*entries)).alias("b")).select("b.*")
    return rows.withColumn("color", legend_color("grp", "color", F.lit(active)))
