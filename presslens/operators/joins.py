"""Joins that line up series, exposures and panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslens.operators.windows import in_blocks


def link_articles(events: DataFrame, mentions: DataFrame, articles: DataFrame) -> DataFrame:
    return events.join(mentions, "event_id").join(articles, "article_id")


def symmetric(pairs: DataFrame, value: str, out: str) -> DataFrame:
    """Both directions of a pair in one row, the smaller id as ``a``."""
    ends = [F.least("src_entity_id", "dst_entity_id").alias("a"), F.greatest("src_entity_id", "dst_entity_id").alias("b")]
    return pairs.groupBy("date", *ends).agg(F.sum(value).alias(out))


def build_panel(features: DataFrame, targets: DataFrame, feature: str, lag_days: int = 1, horizon: int = 5, max_age_days: int = 30, price: str = "px") -> DataFrame:
    """(date, entity_id, y, feature, x_date): return over ``horizon`` trading days, and the latest feature ``lag_days`` before or earlier.

    As-of by one sorted pass over features and targets together: no pair of rows is ever made. The pass is cut
    into blocks of days; features go into the next block too if a target there may still take them.
    """
    ahead = Window.partitionBy("entity_id").orderBy("date")
    y = targets.withColumn("y", F.lead(price, horizon).over(ahead) / F.col(price) - 1).filter("y is not null")
    left = y.select("entity_id", F.date_sub("date", lag_days).alias("at"), F.lit(1).alias("side"), "date", "y", F.lit(None).cast("struct<d:date,x:double>").alias("f"))
    right = features.select("entity_id", F.col("date").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("y"), F.struct(F.col("date").alias("d"), F.col(feature).cast("double").alias("x")).alias("f"))
    asof = Window.partitionBy("entity_id", "w_block").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    blocks = in_blocks(left.unionByName(right), "at", max_age_days, max(366, 4 * max_age_days)).filter("w_own or side = 0")
    met = blocks.withColumn("last", F.last("f", ignorenulls=True).over(asof)).filter("side = 1")
    fresh = met.filter(F.col("last").isNotNull() & (F.date_diff("date", F.col("last.d")) <= max_age_days))
    return fresh.select("date", "entity_id", "y", F.col("last.x").alias(feature), F.col("last.d").alias("x_date"))


def with_controls(panel: DataFrame, controls: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    for control, keys in controls:
        panel = panel.join(control, list(keys), "left")
    return panel


def in_universe(df: DataFrame, members: DataFrame, start: str, end: str, day: str = "date") -> DataFrame:
    return df.filter(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))).join(members, "entity_id", "left_semi")


def missing_refs(specs: DataFrame, registry: DataFrame) -> DataFrame:
    """(spec_id, ref_id): ids that a spec names and the registry lacks."""
    named = specs.select("spec_id", F.explode("refs").alias("ref_id"))
    return named.join(registry.select(F.col("id").alias("ref_id")).distinct(), "ref_id", "left_anti").distinct().select("spec_id", "ref_id")
