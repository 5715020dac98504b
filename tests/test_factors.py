import datetime as dt

import numpy as np
import pandas as pd

from presslens.operators import factors


def test_loadings_equal_pca_of_each_windows_rows(spark):
    rng = np.random.default_rng(8)
    days = [dt.date(2001, 1, 1) + dt.timedelta(days=7 * i) for i in range(160) if i % 40 > 4]
    base = rng.normal(size=(len(days), 2))
    turn = np.linspace(0, 3, len(days))
    x = np.column_stack([base[:, 0] * np.cos(turn) + 5, base[:, 0] * np.sin(turn), base[:, 1] * 0.4, base.sum(axis=1) * 0.3]) + rng.normal(size=(len(days), 4)) * 0.05
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(date=days, g="g")
    df = spark.createDataFrame(pd.concat([pdf, pdf.head(3).assign(a=None, g="g").astype({"a": float})]).replace({np.nan: None})).repartition(3)
    got = factors.window_components(df, list("abcd"), 6, 3, ["g"]).orderBy("component", "month").collect()
    months = sorted({d.replace(day=1) for d in days})
    last, seen = {}, 0
    for r in got:
        end = r["month"]
        back = (end.year * 12 + end.month - 1) - 5
        lo = dt.date(back // 12, back % 12 + 1, 1)
        part = pdf[(pdf.date >= lo) & pdf.date.map(lambda d, end=end: d.replace(day=1) <= end)][list("abcd")].to_numpy()
        values, vectors = np.linalg.eigh(np.cov(part.T))
        v, mine = vectors[:, ::-1][:, r["component"]], np.array(r["loadings"])
        assert r["n"] == len(part) and abs(r["share"] - values[::-1][r["component"]] / values.sum()) < 1e-9
        assert abs(abs(v @ mine) - 1) < 1e-9
        before = last.get(r["component"])
        assert mine @ before > -1e-9 if before is not None else mine[np.abs(mine).argmax()] > 0
        last[r["component"]] = mine
        seen += 1
    assert seen > 3 * (len(months) - 4)


def test_flat_and_empty_windows(spark):
    flat = spark.createDataFrame([(dt.date(2001, 1, i), 1.0, 2.0) for i in range(1, 20)], "date date, a double, b double")
    assert factors.window_components(flat, ["a", "b"], 3).count() == 0
    assert factors.window_components(flat.limit(0), ["a", "b"], 3).count() == 0
