import datetime as dt

import numpy as np
import pandas as pd
import pytest

from presslens.operators import hypotheses

STARTS = [str(d.date()) for d in pd.date_range("2002-01-01", "2004-12-31", freq="6MS")]


def made(seed=3, entities=10, days=1000):
    """Two features: one moves the target, the other is noise."""
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(entities):
        for i in range(0, days):
            day = dt.date(2001, 1, 1) + dt.timedelta(days=i)
            x, noise, m = rng.normal(), rng.normal(), rng.normal()
            y = -0.5 * x + 0.2 * m + 0.1 * e + rng.normal()
            known = day + dt.timedelta(days=5)
            rows += [("signal", f"E{e}", day, m, float(x), y, known), ("noise", f"E{e}", day, m, float(noise), y, known)]
    return pd.DataFrame(rows, columns=["feature_id", "entity_id", "date", "momentum", "v_7", "y_5", "y_date_5"])


@pytest.fixture(scope="module")
def data(spark):
    pdf = made()
    regions = spark.createDataFrame([(f"E{e}", f"R{e % 3}") for e in range(10)], "entity_id string, region string")
    return pdf, spark.createDataFrame(pdf), regions


def refit(pdf):
    """Slope and clustered error of x with momentum beside it and a dummy for each entity."""
    z = pdf.dropna(subset=["y_5", "momentum", "v_7"])
    d = z.groupby("entity_id")[["v_7", "momentum", "y_5"]].transform(lambda c: c - c.mean())
    x, y = d[["v_7", "momentum"]].to_numpy(), d["y_5"].to_numpy()
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    u = pd.DataFrame(x * (y - x @ b)[:, None]).groupby(z["entity_id"].to_numpy()).sum().to_numpy()
    g = len(u)
    return b[0], np.sqrt((inv @ u.T @ u @ inv)[0, 0] * g / (g - 1)), len(z)


def test_a_planted_signal_is_supported_and_noise_is_not(spark, data):
    _, df, regions = data
    specs = spark.createDataFrame([("signal", 7, 5, "f", -1.0), ("noise", 7, 5, "f", -1.0)], "feature_id string, window_days int, horizon int, family string, expected_sign double")
    got = {r["feature_id"]: r for r in hypotheses.run_hypotheses(df, specs, STARTS, "v", [7], [5], regions).collect()}
    assert got["signal"]["verdict"] == "supported" and got["signal"]["reason"] is None and abs(got["signal"]["coef"] + 0.5) < 0.05
    assert got["signal"]["slices_passed"] == 3 and got["signal"]["placebo_p"] == 1 / 21 and got["signal"]["q"] < 1e-6 and got["signal"]["r2_oos"] > 0.1
    assert got["noise"]["verdict"] != "supported" and got["noise"]["reason"] is not None
    turned = hypotheses.run_hypotheses(df, specs.withColumn("expected_sign", -specs["expected_sign"]), STARTS, "v", [7], [5], regions).collect()
    assert {r["feature_id"]: r["verdict"] for r in turned}["signal"] == "rejected"


def test_checks_equal_refits_and_training_is_purged(spark, data):
    pdf, df, regions = data
    from pyspark.sql import functions as F

    forms = {("window", "7"): (F.col("v_7"), None), ("extremes", "dropped"): (F.col("v_7"), F.abs("v_7") < 1)}
    got = {(r["feature_id"], r["kind"], r["check_id"]): r for r in hypotheses.robustness_checks(df, forms, ("window", "7"), 5, regions, STARTS, 2).collect()}
    z = pdf[pdf.feature_id == "signal"]
    cases = {("window", "7"): z, ("extremes", "dropped"): z[z.v_7.abs() < 1]}
    cases |= {("without_entity", f"E{e}"): z[z.entity_id != f"E{e}"] for e in range(10)}
    cases |= {("without_region", f"R{r}"): z[~z.entity_id.str[1:].astype(int).mod(3).eq(r)] for r in range(3)}
    cases |= {("train_window", str(i + 1)): z[z.y_date_5 < dt.date.fromisoformat(s)] for i, s in enumerate(STARTS)}
    for (kind, name), part in cases.items():
        b, se, n = refit(part)
        r = got["signal", kind, name]
        assert r["n"] == n and abs(r["coef"] - b) < 1e-9 and abs(r["se"] - se) < 1e-9, (kind, name)
    assert {k for _, k, _ in got} == {"window", "extremes", "without_entity", "without_region", "train_window", "shuffle_date", "shuffle_entity", "shuffle_feature"}
    assert all(abs(got["signal", "shuffle_date", str(i)]["coef"]) < 0.1 for i in range(2))


def test_collinear_and_empty(spark, data):
    _, df, regions = data
    flat = df.filter("feature_id = 'noise' and entity_id < 'E3'").withColumn("v_7", df["momentum"] * 2)
    rows = hypotheses.hypothesis_rows(flat, "v", [7], [5])
    own = hypotheses.centred(hypotheses.moments(rows, [*hypotheses.SPEC, "entity_id"], ["x", "momentum"]), 2)
    fit = hypotheses.tested(hypotheses.solved(hypotheses.pooled(own, hypotheses.SPEC, 2), 2, hypotheses.SPEC)).collect()
    assert len(fit) == 1 and fit[0]["beta0"] is None and fit[0]["p"] is None
    assert hypotheses.pooled(own.limit(0), hypotheses.SPEC, 2).count() == 0


def test_shuffling_keeps_each_groups_values(spark, data):
    _, df, _ = data
    few = df.filter("entity_id < 'E2' and date < '2001-02-01'")
    got = hypotheses.shuffled(few, ["v_7"], ["feature_id", "entity_id", "date"], ["feature_id", "entity_id"], [0, 1], 7).toPandas()
    was = few.toPandas()
    for (run, f, e), part in got.groupby(["run_id", "feature_id", "entity_id"]):
        own = was[(was.feature_id == f) & (was.entity_id == e)].sort_values("date")
        assert sorted(part.v_7) == sorted(own.v_7) and list(part.sort_values("date").v_7) != list(own.v_7)


def test_features_are_sums_up_to_the_day_before(spark):
    day = lambda i: dt.date(2020, 1, i)
    daily = spark.createDataFrame([("f", "E", day(i), float(2**i)) for i in (1, 2, 5, 9)], "feature_id string, entity_id string, date date, v double")
    targets = spark.createDataFrame([("E", day(i), float(i)) for i in (2, 3, 9, 10)], "entity_id string, date date, px double")
    got = {r["date"].day: r for r in hypotheses.feature_panel(daily, targets, ["f", "other"], ["v"], [3, 7], [1]).filter("feature_id = 'f'").collect()}
    assert [got[i]["v_3"] for i in (2, 3, 9, 10)] == [2.0, 6.0, 0.0, 512.0] and [got[i]["v_7"] for i in (9, 10)] == [4.0 + 32.0, 32.0 + 512.0]
    assert got[3]["y_1"] == 2.0 and got[3]["y_date_1"] == day(9) and got[3]["momentum"] == 0.5 and got[10]["y_1"] is None
