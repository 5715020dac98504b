"""What the corpus operators share: reading tables, scratch tables, word rules, sorted runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.functions.runs import whole_runs
from presslens.scratch import materialize, workspace

__all__ = ["WORD", "materialize", "spread", "table", "text_or_empty", "whole_runs", "workspace"]

#: Everything but the space and the five control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if it comes in fewer partitions than there are cores (one small file, one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))

