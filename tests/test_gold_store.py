import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from presslens.operators import gold_store, silver

DAY = dt.date(2019, 1, 1)


def events(spark, seed=4, days=800, n=1500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        d = DAY + dt.timedelta(days=rng.randrange(days))
        a, b = rng.sample(["A", "B", "C"], 2)
        rows.append((f"e{i}", d, a, b, "19" if rng.random() < 0.5 else "04", 4 if rng.random() < 0.5 else 1, rng.uniform(-5, 5), rng.uniform(-5, 5), rng.randint(1, 20), rng.randint(1, 4), f"src{rng.randrange(4)}"))
    df = spark.createDataFrame(rows, "source_event_id string, event_date date, actor1_entity_id string, actor2_entity_id string, cameo_root_code string, quad_class int, goldstein double, avg_tone double, num_mentions long, num_sources int, source_domain string")
    return silver.map_relation(df)


def shown(df):
    names = [c for c in df.columns if c != "created_at"]
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if kinds[c] == "double" else c for c in sorted(names)])


def same(a, b):
    a, b = shown(a), shown(b)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_refreshed_gold_equals_a_full_rebuild_and_readers_keep_their_snapshot(spark, tmp_path):
    store = gold_store.GoldStore(spark, str(tmp_path / "gold"), [gold_store.PAIRS])
    first = events(spark)
    assert store.refresh(first) == 1
    pinned = store.read("pair_window", snapshot=1)
    before = shown(pinned).collect()
    late = events(spark, 9, 800, 12)
    second = first.unionByName(late)
    assert store.refresh(second, late.select(F.col("event_date").alias("date"))) == 2
    # a mapping change from one day on, and a date that loses all its events
    moved = second.withColumn("actor1_entity_id", F.when((F.col("actor1_entity_id") == "C") & (F.col("event_date") >= "2021-01-10"), "D").otherwise(F.col("actor1_entity_id")))
    gone = first.agg(F.min("event_date")).first()[0]
    third = moved.filter(F.col("event_date") != gone)
    touched = second.filter((F.col("actor1_entity_id") == "C") & (F.col("event_date") >= "2021-01-10")).select(F.col("event_date").alias("date")).unionByName(spark.createDataFrame([(gone,)], "date date"))
    assert store.refresh(third, touched) == 3
    whole = gold_store.GoldStore(spark, str(tmp_path / "whole"), [gold_store.PAIRS])
    whole.refresh(third)
    assert same(store.read("pair_day"), whole.read("pair_day")) and same(store.read("pair_window"), whole.read("pair_window"))
    assert sorted(map(str, shown(pinned).collect())) == sorted(map(str, before))
    assert store.read("pair_day", snapshot=1).agg(F.sum("event_count")).first()[0] == 1500
    kept = {(m, v) for m, v in store.manifest(3)["pair_day"].items()}
    assert {v for _, v in kept} == {1, 2, 3}  # months that nothing touched are those of the first snapshot
    store.vacuum(1)
    assert same(store.read("pair_window"), whole.read("pair_window")) and store.latest() == 3


def test_reads_prune_partitions_and_unfinished_snapshots_are_not_seen(spark, tmp_path):
    store = gold_store.GoldStore(spark, str(tmp_path), [gold_store.STATES])
    with pytest.raises(ValueError):
        store.read("state_day")
    store.refresh(events(spark, n=300))
    part = store.read("state_window", "2019-03-05", "2019-04-20")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and len(part.inputFiles()) <= 2
    dates = {r["date"] for r in part.collect()}
    assert dates and min(dates) >= dt.date(2019, 3, 5) and max(dates) <= dt.date(2019, 4, 20)
    (tmp_path / "_snapshots" / "2").mkdir()  # a writer that has not ended
    assert store.latest() == 1
    assert store.read("state_day", "2030-01-01", "2030-02-01").count() == 0


def test_frontier(spark):
    got = {r["date"]: r["reads"] for r in gold_store.frontier(spark.createDataFrame([(DAY,)], "date date")).collect()}
    at = lambda i: got.get(DAY + dt.timedelta(days=i))
    assert (at(0), at(1), at(29), at(30), at(394), at(395)) == ("daily", "window", "window", "baseline", "baseline", None)
