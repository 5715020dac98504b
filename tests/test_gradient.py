"""Gradients against differences of the index itself."""

from dataclasses import replace

import pytest

from presslens.config import DEFAULT
from presslens.operators.robustness import GRADIENT, index_gradient

SCHEMA = "actor1_entity_id string, relation_id string, event_date string, num_mentions long, num_sources long, goldstein double, avg_tone double"
ROWS = [
    ("A", "verbal_conflict", "2024-01-01", 12, 3, -4.0, -2.5), ("A", "cooperation", "2024-01-20", 3, 1, 6.0, 4.0), ("A", "material_conflict", "2024-01-30", 40, 9, -9.0, -7.0),
    ("B", "cooperation", "2024-01-30", 5, 2, 1.0, 0.0), ("B", "trade_tension", "2024-01-12", 0, 2, 1.0, 1.0), ("B", "verbal_conflict", "2024-01-12", 2, None, None, None),
    ("A", "protest_pressure", "2024-01-30", 9, 9, 1.0, 1.0), ("A", "cooperation", "2024-02-01", 9, 9, 1.0, 1.0), ("A", "cooperation", None, 9, 9, 1.0, 1.0), (None, None, None, None, None, None, None),
]


def test_slopes_are_those_of_finite_differences(spark):
    events = spark.createDataFrame(ROWS, SCHEMA)
    at = lambda cfg: {r["entity_id"]: r for r in index_gradient(events, "actor1_entity_id", "2024-01-31", cfg=cfg).collect()}
    here, h = at(DEFAULT), 1e-4
    assert set(here) == {"A", "B"}
    for name in GRADIENT:
        up, down = (at(replace(DEFAULT, **{name: getattr(DEFAULT, name) + step})) for step in (h, -h))
        for entity, row in here.items():
            assert row[f"d_{name}"] == pytest.approx((up[entity]["index"] - down[entity]["index"]) / (2 * h), rel=1e-5, abs=1e-7), (name, entity)
    a = here["A"]
    assert a["index"] == pytest.approx(a["d_verbal_conflict"] + a["d_material_conflict"] - a["d_cooperation"]) and a["d_trade_tension"] == 0
    assert index_gradient(events.limit(0), "actor1_entity_id", "2024-01-31").collect() == []
