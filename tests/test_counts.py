import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from presslens.operators import counts


def planted(seed=5, senders=14, receivers=12, periods=16):
    rng = np.random.default_rng(seed)
    rows, truth = [], {}
    for r, (const, kappa, slope) in {"calm": (-1.0, 1.5, 0.5), "tense": (0.5, 8.0, -0.3)}.items():
        a, b = rng.normal(0, 0.5, senders), rng.normal(0, 0.4, receivers)
        a, b = a - a.mean(), b - b.mean()
        truth[r] = (const, kappa, slope, a, b)
        for i in range(senders):
            for j in range(receivers):
                for t in range(periods):
                    e, x = rng.uniform(1, 6), rng.normal()
                    mu = e * math.exp(const + a[i] + b[j] + slope * x)
                    rows.append((r, f"S{i:02}", f"R{j:02}", float(rng.poisson(rng.gamma(kappa, mu / kappa))), e, x))
    return pd.DataFrame(rows, columns=["relation_id", "src_entity_id", "dst_entity_id", "n", "e", "x"]), truth


def test_planted_effects_slopes_and_sizes_are_recovered(spark):
    pdf, truth = planted()
    fit = counts.negbin_effects(spark.createDataFrame(pdf).coalesce(2), "n", "e", xs=["x"])
    assert fit.settled and fit.rounds < 40
    whole = {r["relation_id"]: r for r in fit.relations.collect()}
    effects = fit.effects.toPandas()
    for r, (const, kappa, slope, a, b) in truth.items():
        got = whole[r]
        assert abs(got["const"] - const) < 0.1 and abs(got["x"] - slope) < 0.06 and abs(math.log(got["kappa"] / kappa)) < 0.25
        for kind, planted_ in (("out", a), ("in", b)):
            mine = effects[(effects.relation_id == r) & (effects.kind == kind)].sort_values("entity_id").effect.to_numpy()
            assert abs(mine.mean()) < 1e-9 and np.corrcoef(mine, planted_)[0, 1] > 0.93
        # the score equations of a maximum, from the rows
        z = pdf[pdf.relation_id == r]
        out = effects[(effects.relation_id == r) & (effects.kind == "out")].set_index("entity_id").effect
        into = effects[(effects.relation_id == r) & (effects.kind == "in")].set_index("entity_id").effect
        mu = z.e * np.exp(got["const"] + z.src_entity_id.map(out) + z.dst_entity_id.map(into) + got["x"] * z.x)
        u, w = (z.n - mu) / (1 + mu / got["kappa"]), mu / (1 + mu / got["kappa"])
        assert (u.groupby(z.src_entity_id).sum() / w.groupby(z.src_entity_id).sum()).abs().max() < 1e-3
        assert (u.groupby(z.dst_entity_id).sum() / w.groupby(z.dst_entity_id).sum()).abs().max() < 1e-3
        assert abs((u * z.x).sum() / (w * z.x * z.x).sum()) < 1e-3


def test_silent_senders_are_bounded_and_an_early_end_warns(spark):
    rows = [("r", s, d, 0.0 if s == "silent" else float(k), 1.0) for s in ("silent", "a", "b") for d in ("x", "y") for k in (0, 1, 3, 2)]
    df = spark.createDataFrame(rows + [("r", "a", None, 1.0, 1.0), ("r", "a", "x", 4.0, 0.0)], "relation_id string, src_entity_id string, dst_entity_id string, n double, e double").coalesce(1)
    fit = counts.negbin_effects(df, "n", "e")
    effects = {(r["kind"], r["entity_id"]): r["effect"] for r in fit.effects.collect()}
    assert fit.settled and effects["out", "silent"] < -5 and effects["out", "a"] == pytest.approx(effects["out", "b"], abs=1e-3)
    assert fit.relations.first()["n"] == 24
    with pytest.warns(UserWarning, match="still moved"):
        assert not counts.negbin_effects(df, "n", "e", rounds=1).settled
    assert counts.negbin_effects(df.limit(0), "n", "e").effects.count() == 0


def test_gamma_functions(spark):
    got = spark.createDataFrame([(x,) for x in (0.05, 0.5, 1.0, 3.7, 40.0)], "x double").select(counts.digamma(F.col("x")), counts.trigamma(F.col("x"))).collect()
    h = 1e-4
    for x, (d, t) in zip((0.05, 0.5, 1.0, 3.7, 40.0), got, strict=True):
        assert d == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-5)
        assert t == pytest.approx((math.lgamma(x + h) - 2 * math.lgamma(x) + math.lgamma(x - h)) / (h * h), rel=1e-3)
