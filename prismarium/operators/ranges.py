"""Rows of groups of any size in order: cut into sorted ranges, each in one task, whatever share of the rows a group has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismarium.session import Scratch

PART = "_part"


def ranged(df: DataFrame, group: list[str], order: list[str], scratch: Scratch | None = None) -> DataFrame:
    """``df`` ranged by group and order, and stored once with the number of each row's range, so that all that follows sees the same ranges."""
    scratch = scratch or Scratch(df.sparkSession)
    return scratch.save(df.repartitionByRange(*group, *order).withColumn(PART, F.spark_partition_id()))


def numbered(df: DataFrame, group: str, order: list[str], rank: str, size: str, scratch: Scratch | None = None) -> DataFrame:
    """``df`` with each row's place in its group, from 1, and the group's size."""
    placed = ranged(df, [group], order, scratch)
    over = Window.partitionBy(group).orderBy(PART)
    counts = placed.groupBy(group, PART).agg(F.count("*").alias("_n"))
    before = counts.select(F.col(group).alias("_g"), F.col(PART).alias("_p"), F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias(size))
    own = placed.withColumn("_own", F.row_number().over(Window.partitionBy(group, PART).orderBy(*order)))
    return own.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col(PART) == F.col("_p"))).withColumn(rank, F.col("_own") + F.col("_before")).drop("_g", "_p", "_own", "_before", PART)
