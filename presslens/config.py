"""Defaults of every operator, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # event weights
    mentions_power: float = 0.5
    sources_power: float = 0.7
    goldstein_weight: float = 0.6
    tone_weight: float = 0.4
    tone_scale: float = 10.0
    diversity_weight: float = 0.5
    copy_penalty: float = 0.6
    # evidence
    min_sources: int = 2
    min_mentions: int = 3
    # seasonal scores: the frame ends before the day that is scored
    lookback_days: int = 365
    gap_days: int = 8
    min_periods: int = 90
    epsilon: float = 1e-6
    half_life_days: float = 14.0
    windows: tuple[int, ...] = (7, 14, 30)
    # limits of the read API
    max_days: int = 3650
    max_entities: int = 100
    max_rows: int = 10_000
    retention_days: dict[str, int] = field(default_factory=lambda: {"bronze": 90, "temp": 7})


DEFAULT = Config()

# The relation ids that may be used.
RELATIONS = (
    "cooperation", "verbal_conflict", "material_conflict", "sanction_pressure", "protest_pressure", "repression_pressure",
    "financial_stress", "monetary_policy_bias", "energy_security", "trade_tension", "political_uncertainty", "humanitarian_stress",
)
# The themes that financial stress is read from.
FINANCIAL_THEMES = ("CURRENCY", "DEBT", "BANKING", "IMF", "INFLATION")
# How coarse event codes map to relations. The first rule that fits decides.
RELATION_RULES = [
    ("protest_pressure", "root", ("14",)),
    ("cooperation", "quad", (1, 2)),
    ("verbal_conflict", "quad", (3,)),
    ("material_conflict", "quad", (4,)),
]
FINE_RULES = [  # (priority, root codes, relation, sign)
    (1, "14", "protest_pressure", 1), (1, "17", "repression_pressure", 1), (1, "18", "material_conflict", 1),
    (1, "19", "material_conflict", 1), (1, "20", "material_conflict", 1), (2, "11", "verbal_conflict", 1), (3, "04", "cooperation", -1),
]
CONFLICT = ("verbal_conflict", "material_conflict", "sanction_pressure", "trade_tension")
TENSION_WEIGHTS = {"verbal_conflict": 1.0, "material_conflict": 1.0, "sanction_pressure": 1.0, "trade_tension": 1.0, "cooperation": -1.0}
RISK_WEIGHTS = {"financial_stress": 1.0, "social_unrest": 1.0, "external_conflict": 1.0, "negative_tone": 1.0, "capital_flight": 1.0, "external_shock": 1.0}
# Words of policy uncertainty, of tight and of easy policy.
UNCERTAINTY_TERMS = ("uncertain", "unclear", "divided", "surprise", "unexpected", "policy path", "guidance")
HAWKISH = ("rate hike", "tightening", "restrictive policy", "inflation pressure", "higher for longer", "policy normalization", "currency defense", "central bank credibility", "inflation")
DOVISH = ("rate cut", "easing", "stimulus", "recession risk", "growth slowdown", "unemployment", "liquidity injection", "credit support")
FLIPS = ("unlikely", "not", "no", "without", "falling", "ruled out")
SCORE_WEIGHTS = {"predictive_power": 0.35, "calibration": 0.20, "stability": 0.25, "complexity": -0.10, "data_cost": -0.10}
ALLOWED_MODELS = ("panel_ols", "logit", "poisson", "negbin")
MOVES = [  # status moves that are allowed
    ("draft", "compiled"), ("compiled", "queued"), ("queued", "running"), ("running", "supported"), ("running", "rejected"), ("running", "inconclusive"),
    ("supported", "promoted_to_candidate_factor"), ("promoted_to_candidate_factor", "deprecated"), ("supported", "deprecated"),
]
