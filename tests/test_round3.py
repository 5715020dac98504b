"""What the findings of round 3 were about: reads, plans and shuffles of single steps, and two results."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from presslens.operators import counts, gold, graph_series, hypotheses, models, ranges, silver, windows
from presslens.plans import load
from presslens.plans.catalog import QUERIES
from tests.test_hypotheses import STARTS, made

SF = "/root/testdata/sf0.001"
load()


def counted(spark, df):
    """``df`` with an accumulator that counts how often its rows are made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), made


@pytest.fixture(scope="module")
def panel(spark):
    regions = spark.createDataFrame([(f"E{e}", f"R{e % 3}") for e in range(10)], "entity_id string, region string")
    return spark.createDataFrame(made(days=300)), regions


def test_f1_runs_end_in_a_small_plan(spark, panel):
    df, regions = panel
    specs = spark.createDataFrame([("signal", 7, 5, "signal", -1.0), ("noise", 7, 5, "noise", -1.0)], "feature_id string, window_days int, horizon int, family string, expected_sign double")
    out = hypotheses.run_hypotheses(df, specs, STARTS, "v", [7], [5], regions)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "run_id" not in plan and "q_c0_0_c0_0" not in plan


def test_f3_values_that_are_all_equal_have_no_spread(spark):
    days = [dt.date(2001, 1, 1) + dt.timedelta(days=i) for i in range(500)]
    rows = [(d, "A", 5.0 + i if i < 100 else 1 / 7) for i, d in enumerate(days)] + [(days[-1] + dt.timedelta(days=1), "A", 0.25)]
    scored = windows.seasonal_z(spark.createDataFrame(rows, "date date, k string, v double"), ["k"], "v", min_periods=3)
    last = scored.orderBy(F.desc("date")).first()
    assert last["zscore"] == pytest.approx((0.25 - 1 / 7) / 1e-6, abs=1e-3) and sorted(scored.columns) == ["date", "k", "v", "zscore"]


def test_f4_ranks_are_exact_to_far_more_digits_than_are_shown(spark):
    rng = np.random.default_rng(2)
    p = np.where(rng.random((12, 12)) < 0.3, rng.random((12, 12)), 0.0)
    rows = [(dt.date(2001, 1, 1), f"N{a:02}", f"N{b:02}", float(p[a, b])) for a in range(12) for b in range(12) if p[a, b]]
    nodes = sorted({x for r in rows for x in r[1:3]})
    m = np.array([[p[int(a[1:]), int(b[1:])] for b in nodes] for a in nodes])
    out = m.sum(axis=1, keepdims=True)
    m = np.where(out > 0, m / np.where(out > 0, out, 1), 1 / len(nodes))
    want = np.linalg.solve(np.eye(len(nodes)) - 0.85 * m.T, np.full(len(nodes), 0.15 / len(nodes)))
    got = {r["node"]: r["rank"] for r in graph_series.pagerank_series(spark.createDataFrame(rows, "month date, src_entity_id string, dst_entity_id string, weight double")).collect()}
    assert [got[n] for n in nodes] == pytest.approx(want.tolist(), abs=1e-12)


def test_f7_steps_of_negbin_do_not_make_the_panel_anew(spark):
    rows = [(float(i % 5), float(i % 3), 2.0 + i % 4) for i in range(200)]
    df, times = counted(spark, spark.createDataFrame(rows, "y double, x double, e double"))
    models.negbin(df, "y", ["x"], "e", 5.0)
    assert times.value == len(rows)


def test_f8_f9_ranges_carry_only_what_the_weights_need(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ranges, "materialize", lambda df, label, write=ranges.materialize: seen.append(sorted(df.columns)) or write(df, label))
    for name in ("e7_copy_penalty", "e8_full_event_weight"):
        QUERIES[name](spark, SF).count()
    assert seen == [["dedupe_key", "range_part", "source_event_id"], ["dedupe_key", "range_part", "source_event_id", "w"]]


def test_f8_f9_groups_inside_a_range_are_not_added_up(spark):
    rows = [(f"g{i:04}", i) for i in range(400)] + [("g0100", 1000 + i) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = ranges._dealt(spark.createDataFrame(rows, "g string, v int").repartition(3), ["v"], ["g"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    starts = ranges._continued(ranged, ["g"], F.sum(F.lit(1)), F.sum("range_total"))
    assert starts.count() < 4 and {r["g"] for r in starts.collect()} == {"g0100"}
    got = ranges.running_before(spark.createDataFrame(rows, "g string, v int"), ["v"], F.lit(1), "n", ["g"])
    assert {(r["g"], r["v"]): r["n"] for r in got.collect()} == {(g, v): 0 if v < 1000 and g != "g0100" or v == 100 else v - 999 for g, v in rows}


def test_f10_only_wanted_columns_travel_with_a_key(spark):
    plan = QUERIES["p11_dedupe_events"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan


def test_f10_folding_keeps_the_other_columns_of_the_first(spark):
    rows = [("k", "b", 2, 5, "u", "late"), ("k", "a", 3, 4, "v", "early"), ("j", "c", 1, 1, "u", None)]
    got = silver.dedupe_events(spark.createDataFrame(rows, "dedupe_key string, source_event_id string, num_mentions long, num_sources int, source_url string, note string"))
    assert got.columns == ["dedupe_key", "source_event_id", "note", "num_mentions", "num_sources", "source_url", "n_urls", "copies"]
    assert sorted(map(tuple, got.collect()), key=str) == [("j", "c", None, 1, 1, "u", 1, 1), ("k", "a", "early", 5, 5, "u", 2, 2)]


def test_f11_cells_read_the_events_once(spark):
    rows = [(dt.date(2001, 1 + i % 12, 1), f"A{i % 4}", f"A{i % 3}", "r" if i % 2 else "s") for i in range(300)]
    df, times = counted(spark, spark.createDataFrame(rows, "event_date date, actor1_entity_id string, actor2_entity_id string, relation_id string"))
    cells = counts.count_cells(df)
    assert cells.agg(F.sum("n")).first()[0] == len(rows) and times.value == len(rows)


def test_f12_gold_windows_come_out_of_one_sorted_pass(spark):
    days = [dt.date(2001, 1, 1) + dt.timedelta(days=i) for i in range(0, 900, 2)]
    daily = spark.createDataFrame([(d, e, float(i % 9)) for e in "AB" for i, d in enumerate(days)], "date date, k string, v double")
    out = gold.windowed(daily, ["k"], ["v"], [], "v", min_periods=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r["k"], r["date"], r["window_days"]): r["v"] for r in out.collect()}
    assert got == {(e, d, n): float(sum(i % 9 for i, x in enumerate(days) if 0 <= (d - x).days < n)) for e in "AB" for d in days for n in (7, 14, 30)}


def test_f16_checks_make_the_panel_once(spark, panel):
    df, regions = panel
    rows, times = counted(spark, df)
    hypotheses.robustness_checks(rows, {("window", "7"): (F.col("v_7"), None)}, ("window", "7"), 5, regions, STARTS, 1).collect()
    assert times.value == df.count()
