"""The read API: every read names its days, so that partitions are pruned, and caps what comes back."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.config import DEFAULT, Config
from presslens.operators.evidence import search_evidence


def guard(start: str, end: str, entities: Sequence[str] = (), cfg: Config = DEFAULT) -> None:
    days = (date.fromisoformat(end) - date.fromisoformat(start)).days + 1
    if days < 1 or days > cfg.max_days:
        raise ValueError(f"{days} days are asked for; 1 to {cfg.max_days} are allowed")
    if len(entities) > cfg.max_entities:
        raise ValueError(f"{len(entities)} entities are asked for; {cfg.max_entities} are allowed")


def between(start: str, end: str, day: str = "date") -> Column:
    return F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def get_world_state(gold: DataFrame, entity: str, state: str, start: str, end: str, cfg: Config = DEFAULT) -> DataFrame:
    guard(start, end, [entity], cfg)
    return gold.filter(between(start, end) & (F.col("entity_id") == entity) & (F.col("state_name") == state)).orderBy("date").limit(cfg.max_rows)


def get_relation_timeseries(gold: DataFrame, src: str, dst: str, relation: str, start: str, end: str, cfg: Config = DEFAULT) -> DataFrame:
    guard(start, end, [src, dst], cfg)
    return gold.filter(between(start, end) & (F.col("src_entity_id") == src) & (F.col("dst_entity_id") == dst) & (F.col("relation_id") == relation)).orderBy("date").limit(cfg.max_rows)


def entity_theme_pressure(gold: DataFrame, entity: str, theme: str, start: str, end: str, cfg: Config = DEFAULT) -> DataFrame:
    guard(start, end, [entity], cfg)
    return gold.filter(between(start, end) & (F.col("entity_id") == entity) & (F.col("theme_id") == theme)).orderBy("date").limit(cfg.max_rows)


def get_hypothesis_result(runs: DataFrame, hypothesis: str) -> DataFrame:
    return runs.filter(F.col("hypothesis_id") == hypothesis)


def latest_versions(registry: DataFrame, by: str, version: str, created: str) -> DataFrame:
    return registry.groupBy(by).agg(F.max_by(version, F.struct(created, version)).alias("version"), F.count("*").alias("n"))


def search(articles: DataFrame, terms: Sequence[str], start: str, end: str, k: int, cfg: Config = DEFAULT, fields: Sequence[str] = ("text",)) -> DataFrame:
    """The best ``k`` articles of a range of days by BM25 over ``fields`` (text, names of persons and organizations, themes), within the caller's limits."""
    guard(start, end, cfg=cfg)
    return search_evidence(articles, terms, start, end, min(k, cfg.max_rows), fields=fields)


def page(df: DataFrame, key: str, after: int | str | None, n: int, cfg: Config = DEFAULT) -> DataFrame:
    """The next rows by key; no offset that grows."""
    rest = df if after is None else df.filter(F.col(key) > after)
    return rest.orderBy(key).limit(min(n, cfg.max_rows))
