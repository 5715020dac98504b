"""Running sums, ranks and minima over a whole order, without bringing it or one of its groups into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.scratch import materialize


def _dealt(df: DataFrame, order: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Rows by ranges of groups and order, written so that every later read sees the same ranges."""
    return materialize(df.repartitionByRange(*groups, *order).withColumn("range_part", F.spark_partition_id()), "ranges")


def _continued(ranged: DataFrame, groups: Sequence[str], folded: Column, across: Column) -> DataFrame:
    """``range_start`` of those ranges whose first group began in an earlier range, from what ``folded`` makes of each.

    A range continues one group at most, so there are fewer rows than ranges and they can be broadcast. A group of two ranges
    or more is the last of one and the first of the next, so that only rows of ranges' first and last groups are added up.
    """
    if groups:
        group = F.struct(*groups)
        ends = ranged.groupBy("range_part").agg(F.min(group).alias("end_first"), F.max(group).alias("end_last")).withColumnRenamed("range_part", "end_part")
        at_end = (F.col("range_part") == F.col("end_part")) & (group.eqNullSafe(F.col("end_first")) | group.eqNullSafe(F.col("end_last")))
        ranged = ranged.join(F.broadcast(ends), at_end, "left_semi")
    totals = ranged.groupBy(*groups, "range_part").agg(folded.alias("range_total"))
    ahead = Window.partitionBy(*groups).orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("range_start", across.over(ahead)).drop("range_total").filter("range_start is not null")


def _beside(ranged: DataFrame, starts: DataFrame, groups: Sequence[str]) -> DataFrame:
    named = starts.select(F.col("range_part").alias("start_part"), F.col("range_start"), *[F.col(g).alias(f"start_of_{g}") for g in groups])
    same = F.col("range_part") == F.col("start_part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"start_of_{g}"))
    return ranged.join(F.broadcast(named), same, "left").drop("start_part", *[f"start_of_{g}" for g in groups])


def running_before(df: DataFrame, order: Sequence[str], value: Column, out: str, groups: Sequence[str] = ()) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows that come before in ``order`` (which has to be total), by group.

    With 1 as ``value`` it counts from 0.
    """
    ranged = _dealt(df, order, groups)
    joined = _beside(ranged, _continued(ranged, groups, F.sum(value), F.sum("range_total")), groups)
    inside = Window.partitionBy(*groups, "range_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.coalesce("range_start", F.lit(0)) + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("range_part", "range_start")


def greatest_before(df: DataFrame, order: Sequence[str], value: Column, out: str, groups: Sequence[str]) -> DataFrame:
    """``df`` with the greatest ``value`` over the rows of its group that come before in ``order`` (which has to be total); else null."""
    ranged = _dealt(df, order, groups)
    joined = _beside(ranged, _continued(ranged, groups, F.max(value), F.max("range_total")), groups)
    inside = Window.partitionBy(*groups, "range_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.greatest("range_start", F.max(value).over(inside))).drop("range_part", "range_start")


def least_before(df: DataFrame, at: str, value: Column, out: str, groups: Sequence[str]) -> DataFrame:
    """``df`` with the least ``value`` (a number or struct) among the rows of its group whose ``at``, a long, is smaller; else null."""
    ranged = _dealt(df, [at], groups)  # rows equal in group and ``at`` share a range
    joined = _beside(ranged, _continued(ranged, groups, F.min(value), F.min("range_total")), groups)
    inside = Window.partitionBy(*groups, "range_part").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.least("range_start", F.min(value).over(inside))).drop("range_part", "range_start")
