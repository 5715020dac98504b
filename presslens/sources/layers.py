"""Comparing builds of a layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_snapshots(a: DataFrame, b: DataFrame) -> DataFrame:
    """(change, n): rows added to ``a`` by ``b``, removed from it, and kept."""
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("change"), "n")
    return count(b.exceptAll(a), "added").unionByName(count(a.exceptAll(b), "removed")).unionByName(count(a.intersectAll(b), "kept"))
