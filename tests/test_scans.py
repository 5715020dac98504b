import datetime as dt

import numpy as np
import pandas as pd
import pytest

from presslens.operators import models, scans


def series(lengths, seed=2):
    rng = np.random.default_rng(seed)
    return pd.DataFrame([(f"E{k}", dt.date(1990, 1, 1) + dt.timedelta(days=int(i)), float(v)) for k, n in enumerate(lengths) for i, v in enumerate(np.cumsum(rng.normal(size=n)) + 100)], columns=["entity_id", "date", "px"])


def folded(y, q, r):
    m, p, out = None, None, []
    for v in y:
        if m is None:
            m, p = v, r
        else:
            g = (p + q) / (p + q + r)
            m, p = m + g * (v - m), (1 - g) * (p + q)
        out.append((m, p))
    back = [out[-1]]
    for m, p in out[-2::-1]:
        e = p / (p + q)
        back.append((m + e * (back[-1][0] - m), p + e * e * (back[-1][1] - p - q)))
    return out, back[::-1]


@pytest.mark.parametrize("lengths", [[1, 2, 700, 3, 64], [6000]])
def test_kalman_and_smoothing_equal_a_plain_fold(spark, lengths):
    pdf = series(lengths)
    df = spark.createDataFrame(pdf).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        got = scans.kalman_series(df, ["entity_id"], "px", 1.0, 10.0).toPandas().sort_values(["entity_id", "date"])
        smooth = scans.exp_smooth_series(df, ["entity_id"], "px", 0.3).toPandas().sort_values(["entity_id", "date"])
        assert len(got) == len(smooth) == sum(lengths)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(len(lengths)):
        y = pdf[pdf.entity_id == f"E{k}"].px.to_numpy()
        seen, back = folded(y, 1.0, 10.0)
        mine = got[got.entity_id == f"E{k}"]
        assert np.allclose(mine[["level", "variance"]].to_numpy(), seen, rtol=1e-9) and np.allclose(mine[["smoothed", "smoothed_variance"]].to_numpy(), back, rtol=1e-9)
        s = [y[0]]
        for v in y[1:]:
            s.append(0.3 * v + 0.7 * s[-1])
        assert np.allclose(smooth[smooth.entity_id == f"E{k}"].smoothed.to_numpy(), s, rtol=1e-9)


def test_last_levels_are_those_of_the_fold_over_arrays_and_one_series_uses_many_tasks(spark):
    df = spark.createDataFrame(series([3000]))
    last = models.kalman_level(df, ["entity_id"], "px", 1.0, 10.0).first()
    rows = scans.kalman_series(df, ["entity_id"], "px", 1.0, 10.0)
    mine = rows.orderBy("date", ascending=False).first()
    assert mine["level"] == pytest.approx(last["level"]) and mine["variance"] == pytest.approx(last["variance"])


def test_missing_values_and_empty_tables(spark):
    pdf = series([50, 4])
    pdf.loc[[0, 10, 20], "px"] = None
    df = spark.createDataFrame(pdf)
    got = scans.exp_smooth_series(df, ["entity_id"], "px", 0.3)
    assert got.count() == 51 and got.filter("smoothed is null or isnan(smoothed)").count() == 0
    assert scans.exp_smooth_series(df.limit(0), ["entity_id"], "px", 0.3).count() == 0
    assert scans.kalman_series(df.limit(0), ["entity_id"], "px", 1.0, 1.0).count() == 0
