"""State indices: weighted sums of components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.config import CONFLICT, DEFAULT, RISK_WEIGHTS, TENSION_WEIGHTS, UNCERTAINTY_TERMS, Config
from presslens.functions.weights import event_weight, tone_risk
from presslens.operators.gold import endpoints, entity_exposure, normalize_entity
from presslens.operators.evidence import lexicon_count
from presslens.operators.windows import seasonal_z


def weighted(name: str, value: str, weights: dict[str, float]) -> Column:
    """Sum of weight times value over rows of a group, by the component's name; no pivot."""
    total = F.lit(0.0)
    for component, w in weights.items():
        total = total + w * F.coalesce(F.sum(F.when(F.col(name) == component, F.col(value))), F.lit(0.0))
    return total


def risk_pressure(states: DataFrame, weights: dict[str, float] = RISK_WEIGHTS, value: str = "zscore") -> DataFrame:
    return states.groupBy("date", "entity_id").agg(weighted("state_name", value, weights).alias("risk_pressure"))


def index_model(states: DataFrame, weights: dict[str, float], value: str = "zscore") -> DataFrame:
    """Score and what each component adds to it: one row per component with its share."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    parts = states.filter(F.col("state_name").isin(*weights)).withColumn("part", F.try_element_at(w, F.col("state_name")) * F.col(value))
    totals = parts.groupBy("date", "entity_id").agg(F.sum("part").alias("score"), F.sum(F.abs("part")).alias("size"))
    return parts.join(totals, ["date", "entity_id"]).select("date", "entity_id", "state_name", "part", "score", F.when(F.col("size") > 0, F.abs("part") / F.col("size")).alias("share"))


def bilateral_tension(pairs: DataFrame, weights: dict[str, float] = TENSION_WEIGHTS, value: str = "weighted_score") -> DataFrame:
    """Directed: how tense src is with dst."""
    return pairs.groupBy("date", "src_entity_id", "dst_entity_id").agg(weighted("relation_id", value, weights).alias("tension"))


def policy_hawkishness(grouped: DataFrame, value: str = "weight") -> DataFrame:
    """From rows of (date, entity_id, theme_group)."""
    parts = {"hawkish": 1.0, "dovish": -1.0, "inflation_concern": 1.0, "growth_concern": -1.0, "currency_defense": 1.0}
    return grouped.groupBy("date", "entity_id").agg(weighted("theme_group", value, parts).alias("policy_hawkishness"))


def policy_uncertainty_counts(articles: DataFrame, terms: Sequence[str] = UNCERTAINTY_TERMS) -> DataFrame:
    """Words of uncertainty per day and entity; their seasonal z-score is the index."""
    return articles.groupBy(F.to_date("published_ts").alias("date"), "entity_id").agg(F.sum(lexicon_count(F.col("text"), terms)).alias("terms"), F.count("*").alias("articles"))


def component(states: DataFrame, names: Sequence[str], value: str = "weighted_score", out: str = "component") -> DataFrame:
    return states.filter(F.col("state_name").isin(*names)).groupBy("date", "entity_id").agg(F.sum(value).alias(out))


def external_conflict(pairs: DataFrame, relations: Sequence[str] = CONFLICT, value: str = "weighted_score") -> DataFrame:
    """What conflict with others touches an entity, as source or target."""
    outside = pairs.filter((F.col("src_entity_id") != F.col("dst_entity_id")) & F.col("relation_id").isin(*relations))
    both = outside.select("date", F.explode(F.array("src_entity_id", "dst_entity_id")).alias("entity_id"), value)
    return both.groupBy("date", "entity_id").agg(F.sum(value).alias("external_conflict"))


def risk_components(events: DataFrame, narratives: dict[str, Sequence[str]], cfg: Config = DEFAULT, min_periods: int | None = None) -> DataFrame:
    """(date, entity_id, state_name, value, exposure_adjusted_score, zscore): unrest, conflict with others, negative tone, and a narrative for each entry of ``narratives`` (name: themes).

    A component is the weight of the events that belong to it, over the entity's exposure of that day; its
    z-score compares it with its own earlier days.
    """
    w, outside = F.col("w"), F.col("actor1_entity_id") != F.col("actor2_entity_id")
    parts = {
        "social_unrest": F.when(F.col("relation_id").isin("protest_pressure", "repression_pressure"), w),
        "external_conflict": F.when(outside & F.col("relation_id").isin(*CONFLICT), w),
        "negative_tone": w * F.greatest(F.lit(0.0), tone_risk(F.col("avg_tone"), cfg.tone_scale)),
    } | {name: F.when(F.col("theme_id").isin(*themes), w) for name, themes in narratives.items()}
    both = endpoints(events.withColumn("w", event_weight(cfg)))
    each = both.select(F.col("event_date").alias("date"), "entity_id", F.explode(F.array(*[F.struct(F.lit(n).alias("state_name"), v.alias("v")) for n, v in parts.items()])).alias("e"))
    daily = each.filter("e.v is not null").groupBy("date", "entity_id", F.col("e.state_name").alias("state_name")).agg(F.sum("e.v").alias("value"))
    return seasonal_z(normalize_entity(daily, entity_exposure(events), "value", cfg=cfg), ["entity_id", "state_name"], "exposure_adjusted_score", cfg=cfg, min_periods=min_periods)


def policy_uncertainty(articles: DataFrame, cfg: Config = DEFAULT, min_periods: int | None = None) -> DataFrame:
    """The index: the seasonal z-score of an entity's words of uncertainty for each article of a day."""
    counts = policy_uncertainty_counts(articles).withColumn("rate", F.col("terms") / F.col("articles"))
    return seasonal_z(counts, ["entity_id"], "rate", "policy_uncertainty", cfg=cfg, min_periods=min_periods)
