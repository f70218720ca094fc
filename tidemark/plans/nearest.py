"""Joins to the nearest row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(asked: DataFrame, known: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """by, at, value, other: each row of ``asked`` (by, at) with the ``known`` row (by, at, value) of the same ``by`` whose
    ``at`` is nearest, ties to the lower; without one there's no row.

    Both sides are one sequence sorted by ``at``; the last known row before and after is carried along it, so the work is
    a sort, not all pairs."""
    both = known.select(by, at, F.struct(at, value).alias("k")).unionByName(asked.select(by, at, F.lit(None).alias("k")), True)
    both = both.withColumn("asks", F.col("k").isNull())
    # equal places: the known row comes first in both directions
    up = Window.partitionBy(by).orderBy(F.col(at), F.col("asks"))
    down = Window.partitionBy(by).orderBy(F.col(at).desc(), F.col("asks"))
    carried = lambda w: F.last("k", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("a", carried(up)).withColumn("b", carried(down)).where("asks")
    lower = F.col("b").isNull() | (F.col("a").isNotNull() & (F.col(at) - F.col("a")[at] <= F.col("b")[at] - F.col(at)))
    best = F.when(lower, F.col("a")).otherwise(F.col("b"))
    return met.select(by, at, best.alias("x")).where("x IS NOT NULL").select(by, at, F.col("x")[value].alias(value), F.col("x")[at].alias("other"))
