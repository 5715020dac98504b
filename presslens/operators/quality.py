"""Data-quality checks. Each gives one row: check_id, passed, value, threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict(df: DataFrame, check: str, value: Column, threshold: float, at_most: bool = True) -> DataFrame:
    v = value.cast("double")
    passed = F.col("value") <= threshold if at_most else F.col("value") >= threshold
    return df.agg(v.alias("value")).select(F.lit(check).alias("check_id"), F.coalesce(passed, F.lit(False)).alias("passed"), "value", F.lit(float(threshold)).alias("threshold"))


def check_rows(df: DataFrame) -> DataFrame:
    return verdict(df, "rows", F.count("*"), 1, at_most=False)


def check_dates(df: DataFrame, day: str, low: str, high: str) -> DataFrame:
    return verdict(df, "date_range", F.count_if(~F.coalesce(F.col(day).between(F.lit(low).cast("date"), F.lit(high).cast("date")), F.lit(False))), 0)


def check_unique(df: DataFrame, keys: Sequence[str], check: str = "unique") -> DataFrame:
    return verdict(df.groupBy(*keys).agg(F.count("*").alias("n")), check, F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)), 0)


def check_rate(df: DataFrame, good: Column, check: str, least: float) -> DataFrame:
    return verdict(df, check, F.avg(F.coalesce(good, F.lit(False)).cast("double")), least, at_most=False)


def check_none(df: DataFrame, bad: Column, check: str, most: float = 0) -> DataFrame:
    return verdict(df, check, F.count_if(F.coalesce(bad, F.lit(False))), most)


def check_complete(df: DataFrame, day: str, keys: Sequence[str] = ()) -> DataFrame:
    """Days between the first and the last, of each group, that have no row."""
    groups = df.groupBy(*keys).agg((F.date_diff(F.max(day), F.min(day)) + 1 - F.count_distinct(day)).alias("missing"))
    return verdict(groups, "missing_dates", F.coalesce(F.sum("missing"), F.lit(0)), 0)


def check_groups_have(df: DataFrame, keys: Sequence[str], value: str, check: str) -> DataFrame:
    """Groups in which ``value`` is null throughout."""
    return verdict(df.groupBy(*keys).agg(F.count(value).alias("n")), check, F.count_if(F.col("n") == 0), 0)


def check_same(a: DataFrame, b: DataFrame, check: str) -> DataFrame:
    """Rows that either side has and the other hasn't."""
    return verdict(a.exceptAll(b).unionByName(b.exceptAll(a)), check, F.count("*"), 0)


def null_rates(df: DataFrame) -> DataFrame:
    """(column, null_rate) of all columns in one pass."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return one.select(F.lit(1).alias("one"), *df.columns).unpivot("one", df.columns, "column", "null_rate").drop("one")


def audit_sample(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key's MD5 starts with ``prefix``: the same ones each time."""
    return df.filter(F.md5(F.col(key).cast("string")).startswith(prefix))
