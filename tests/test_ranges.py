"""Ranks and what came before, over ranges: hot keys, nulls, ties and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from presslens.functions.weights import diversity_factor
from presslens.operators import ranges, silver, windows


def test_greatest_before_follows_the_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(50), i, rng.randrange(1000)) for i in range(500)]
    got = ranges.greatest_before(spark.createDataFrame(rows, "g string, t long, i long, v long").repartition(6), ["t", "i"], F.col("v"), "high", ["g"])
    want = {i: max((w for h, u, j, w in rows if h == g and (u, j) < (t, i)), default=None) for g, t, i, v in rows}
    assert {r["i"]: r["high"] for r in got.collect()} == want
    assert ranges.greatest_before(got.drop("high").limit(0), ["t", "i"], F.col("v"), "high", ["g"]).collect() == []


def test_gaps_of_one_narrative(spark):
    rows = [("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:00:00", 2), ("a", "2024-01-01 00:05:00", 3), ("a", "2024-01-01 02:00:00", 4), (None, "2024-01-01 00:00:00", 5), ("a", None, 6)]
    df = spark.createDataFrame(rows, "k string, ts string, i long").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["i"]: (r["gap"], r["session"], str(r["first_seen"])[:10]) for r in windows.narrative_gaps(df, ["k"], "ts", 600, "i").collect()}
    day = "2024-01-01"
    assert got == {1: (None, 0, day), 2: (0, 0, day), 3: (300, 0, day), 4: (6900, 1, day), 5: (None, 0, day), 6: (None, 0, day)}


def test_leaderboard_with_ties_and_runs_without_a_score(spark):
    runs = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 3.0), ("d", None), ("e", 2.0)], "run string, score double")
    got = {r["run"]: (r["rank"], r["percent_rank"]) for r in windows.leaderboard(runs, "score").collect()}
    assert got == {"a": (1, 0.0), "c": (1, 0.0), "e": (2, 0.5), "b": (3, 0.75), "d": (4, 1.0)}
    assert [(r["rank"], r["percent_rank"]) for r in windows.leaderboard(runs.filter("run = 'e'"), "score").collect()] == [(1, 0.0)]
    assert windows.leaderboard(runs.limit(0), "score").collect() == []


def test_signs_of_slopes(spark):
    betas = spark.createDataFrame([("a", 2.0), ("a", -1.0), ("a", 0.0), ("a", None), ("b", 1.0), ("b", -1.0), ("b", 0.0), ("c", None)], "k string, beta double")
    got = {r["k"]: r["sign_stability"] for r in windows.rolling_stability(betas, ["k"]).collect()}
    assert got == {"a": pytest.approx(1 / 3), "b": pytest.approx(1 / 3), "c": None}


def test_copies_addresses_and_diversity(spark):
    rows = [("k", "e1", "u1", "s1"), ("k", "e2", "u2", "s1"), ("k", "e3", "u1", "s2"), ("l", "e4", None, None), (None, "e5", "u", "s")]
    events = spark.createDataFrame(rows, "dedupe_key string, source_event_id string, source_url string, source_domain string").withColumn("num_mentions", F.lit(2)).withColumn("num_sources", F.lit(1))
    assert {(r[0], r[1], r["n_urls"], r["copies"]) for r in silver.dedupe_events(events).select("dedupe_key", "source_event_id", "n_urls", "copies").collect()} == {("k", "e1", 2, 3), ("l", "e4", 0, 1), (None, "e5", 1, 1)}
    assert {tuple(r) for r in silver.source_urls(events).collect()} == {("k", "u1", 2), ("k", "u2", 1), (None, "u", 1)}
    assert {r["source_event_id"]: r["copy_rank"] for r in silver.copy_ranks(events).collect()} == {"e1": 1, "e2": 2, "e3": 3, "e4": 1, "e5": 1}
    seen = silver.with_diversity(events, ["dedupe_key"]).select("source_event_id", "source_diversity", diversity_factor(F.col("source_diversity")).alias("f"))
    got = {r[0]: (r[1], r[2]) for r in seen.collect()}
    assert got["e1"] == (pytest.approx(9 / 5), pytest.approx(1 + 0.5 * 0.5877866649)) and got["e4"] == (1.0, 1.0) and got["e5"] == (1.0, 1.0)
