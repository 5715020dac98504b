"""Event-weight expressions. Decay is no part of a weight: it is applied once, by ``decay_sum``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from presslens.config import DEFAULT, Config


def mention_damp(mentions: Column, power: float = DEFAULT.mentions_power) -> Column:
    return F.pow(F.log1p(F.coalesce(mentions, F.lit(0))), F.lit(power))


def mention_cap(mentions: Column, cap: float) -> Column:
    return F.least(F.log1p(F.coalesce(mentions, F.lit(0))), F.lit(cap))


def source_factor(sources: Column, power: float = DEFAULT.sources_power) -> Column:
    return F.pow(1 + F.coalesce(sources, F.lit(0)), F.lit(power))


def tone_risk(tone: Column, scale: float = DEFAULT.tone_scale) -> Column:
    """Between -1 and 1; above 0 for a negative tone."""
    return F.tanh(-tone / scale)


def goldstein_conflict(g: Column) -> Column:
    return F.greatest(F.lit(0.0), -g / 10)


def goldstein_cooperation(g: Column) -> Column:
    return F.greatest(F.lit(0.0), g / 10)


def goldstein_intensity(g: Column, weight: float = DEFAULT.goldstein_weight) -> Column:
    return 1 + weight * F.abs(g) / 10


def copy_penalty(rank: Column, base: float = DEFAULT.copy_penalty) -> Column:
    """1 for the first of a group of copies, less for each further one."""
    return F.pow(F.lit(base), rank - 1)


def tau(half_life: float) -> float:
    return half_life / math.log(2)


def event_weight(cfg: Config = DEFAULT) -> Column:
    """From num_mentions, num_sources, goldstein and avg_tone. Every factor stays above 0 but for events nobody mentions."""
    tone = 1 + cfg.tone_weight * F.coalesce(tone_risk(F.col("avg_tone"), cfg.tone_scale), F.lit(0.0))
    strength = goldstein_intensity(F.coalesce(F.col("goldstein"), F.lit(0.0)), cfg.goldstein_weight)
    return mention_damp(F.col("num_mentions"), cfg.mentions_power) * source_factor(F.col("num_sources"), cfg.sources_power) * strength * tone


def diversity_factor(diversity: Column, weight: float = DEFAULT.diversity_weight) -> Column:
    """1 for a single source (or where the number isn't known), more for several."""
    return 1 + weight * F.ln(F.greatest(F.coalesce(diversity, F.lit(1.0)), F.lit(1.0)))


def sourced_event_weight(source_weight: Column, cfg: Config = DEFAULT) -> Column:
    """``event_weight`` times the weight of its source, 1 if there is none."""
    return event_weight(cfg) * F.coalesce(source_weight, F.lit(1.0))


def full_event_weight(source_weight: Column, copy_rank: Column, cfg: Config = DEFAULT, diversity: Column | None = None) -> Column:
    """``event_weight`` times the weight of its source (1 if there is none), the penalty of further copies and, if given, the diversity of its cell."""
    whole = sourced_event_weight(source_weight, cfg) * copy_penalty(copy_rank, cfg.copy_penalty)
    return whole if diversity is None else whole * diversity_factor(diversity, cfg.diversity_weight)
