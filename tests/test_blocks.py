import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from presslens.operators import joins, windows


@pytest.fixture(scope="module")
def one(spark):
    """A single entity over eight years, with gaps, nulls and a level far from 0."""
    rng = np.random.default_rng(6)
    days = [dt.date(1992, 1, 1) + dt.timedelta(days=i) for i in range(2900) if rng.random() < 0.8]
    pdf = pd.DataFrame({"entity_id": "E", "date": days, "v": 1e4 + rng.normal(size=len(days)).cumsum()})
    rows = [(e, d, None if i % 97 == 5 else float(v)) for i, (e, d, v) in enumerate(pdf.itertuples(index=False))]
    return rows, spark.createDataFrame(rows, "entity_id string, date date, v double")


@pytest.fixture(autouse=True)
def apart(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_seasonal_z_equals_a_frame_by_hand_and_one_entity_is_many_tasks(one):
    rows, df = one
    out = windows.seasonal_z(df, ["entity_id"], "v")
    assert tasks(out) > 1
    got = {r["date"]: r["zscore"] for r in out.collect()}
    assert len(got) == len(rows)
    for _, day, v in rows[::13]:
        frame = np.array([x for _, d, x in rows if x is not None and 8 <= (day - d).days <= 365])
        if v is None or len(frame) < 90:
            assert got[day] is None
        else:
            assert got[day] == pytest.approx((v - frame.mean()) / (frame.std(ddof=1) + 1e-6), rel=1e-6)


def test_rolling_sums_and_repeated_days(one):
    rows, df = one
    twice = df.unionByName(df)
    out = windows.rolling_sum(twice, ["entity_id"], "v", 30, "s")
    assert tasks(out) > 1 and out.count() == 2 * len(rows)
    got = {r["date"]: r["s"] for r in out.collect()}
    for _, day, _ in rows[::29]:
        frame = [x for _, d, x in rows if x is not None and 0 <= (day - d).days < 30]
        assert got[day] == pytest.approx(2 * sum(frame)) if frame else got[day] is None


def test_as_of_reaches_over_the_edges_of_blocks(spark, one):
    rows, _ = one
    features = [(e, d, v) for i, (e, d, v) in enumerate(rows) if i % 23 == 0 and v is not None]
    targets = [("E", dt.date(1992, 1, 1) + dt.timedelta(days=i), 100.0 + i) for i in range(0, 2900, 3)]
    out = joins.build_panel(spark.createDataFrame(features, "entity_id string, date date, v double"), spark.createDataFrame(targets, "entity_id string, date date, px double"), "v", 1, 5, 30)
    got = {r["date"]: (r["v"], r["x_date"]) for r in out.collect()}
    for k, (_, day, _) in enumerate(targets):
        fit = [(d, v) for _, d, v in features if 1 <= (day - d).days <= 30]
        assert got.get(day) == ((max(fit)[1], max(fit)[0]) if fit and k + 5 < len(targets) else None)
