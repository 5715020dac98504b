"""Cascades against a walk over every pair of carriers, planted chains and planted leaders."""

import math
import random

from pyspark.sql import functions as F

from presslens.operators import cascades, ranges

SEEN = "group_id string, source string, first_at long"


def by_hand(rows, half_life_hours=24.0):
    groups = {}
    for g, s, t in rows:
        groups.setdefault(g, []).append((t, s))
    weight = {s: 1 for _, s, _ in rows}
    for members in groups.values():
        for t, s in members:
            weight[s] += len(members) > 1 and t == min(members)[0]
    out = {}
    for g, members in groups.items():
        for t, s in sorted(members):
            earlier = [(-(math.log(weight[b]) + (u - min(members)[0]) / (half_life_hours * 3600 / math.log(2))), b) for u, b in members if u < t]
            parent = min(earlier)[1] if earlier else None
            depth, root = (out[g, parent][1] + 1, out[g, parent][2]) if parent else (0, s)
            out[g, s] = (parent, depth, root)
    return out


def test_parents_depths_and_roots_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    rows = [(f"g{g}", f"s{s}", rng.randrange(0, 400_000, 7_000)) for g in range(30) for s in rng.sample(range(40), rng.randint(1, 25))]
    rows += [("hot", f"s{s}", rng.randrange(0, 900_000)) for s in range(600)]
    got = {(r["group_id"], r["source"]): (r["parent"], r["depth"], r["root"]) for r in cascades.propagation(spark.createDataFrame(rows, SEEN).repartition(5)).collect()}
    assert got == by_hand(rows)


def test_a_planted_chain_and_its_delays(spark):
    rows = [("chain", f"s{i:02}", 3600 * 24 * 30 * i) for i in range(21)] + [("star", f"t{i}", 60 * (i > 0)) for i in range(6)] + [("one", "s00", 5)]
    spread = cascades.propagation(spark.createDataFrame(rows, SEEN), half_life_hours=1.0)
    got = {r["group_id"]: r.asDict() for r in cascades.summaries(spread, (2, 10)).collect()}
    assert (got["chain"]["sources"], got["chain"]["max_depth"], got["chain"]["mean_depth"], got["chain"]["delay_10"]) == (21, 20, 10.0, 9 * 3600 * 24 * 30)
    assert (got["star"]["max_depth"], got["star"]["delay_2"], got["star"]["delay_10"]) == (1, 60, None)
    assert (got["one"]["sources"], got["one"]["max_depth"], got["one"]["delay_2"]) == (1, 0, None)


def test_a_planted_leader_beats_chance_and_noise_does_not(spark):
    rng = random.Random(3)
    rows = []
    for g in range(120):
        others = rng.sample([f"n{i}" for i in range(12)], 4)
        rows += [(f"g{g}", "wire", 0), (f"g{g}", "echo", 60)] + [(f"g{g}", s, 1000 * (i + 1)) for i, s in enumerate(others)]
    got = {(r["leader"], r["follower"]): r for r in cascades.leads(spark.createDataFrame(rows, SEEN), rounds=19).collect()}
    assert (got["wire", "echo"]["n"], got["wire", "echo"]["p"], got["wire", "echo"]["n_back"]) == (120, 0.05, 0)
    assert all(0.05 <= r["p"] <= 1 for r in got.values())
    fair = [(f"g{g}", s, 1000 * i) for g in range(120) for i, s in enumerate(rng.sample([f"n{i}" for i in range(8)], 4))]
    ps = [r["p"] for r in cascades.leads(spark.createDataFrame(fair, SEEN), rounds=19).collect()]
    assert sum(p <= 0.05 for p in ps) <= 0.2 * len(ps)


def test_nulls_and_empty_tables(spark):
    articles = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, None, "2024-01-01 00:00:01"), (3, "b", None), (4, "b", "2024-01-02 00:00:00"), (None, "c", "2024-01-01 00:00:00")], "article_id long, source_domain string, published_ts string")
    groups = spark.createDataFrame([(i, "g") for i in (1, 2, 3, 4)], "article_id long, group_id string")
    assert {(r["source"], r["parent"]) for r in cascades.propagation(cascades.carriers(articles, groups)).collect()} == {("a", None), ("b", "a")}
    none = spark.createDataFrame([], SEEN)
    assert cascades.summaries(cascades.propagation(none)).collect() == [] and cascades.leads(none).collect() == []


def test_least_before_is_strict_and_takes_null_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(60), rng.randrange(1000)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, at long, v long").repartition(7)
    got = [tuple(r) for r in ranges.least_before(df, "at", F.col("v"), "low", ["g"]).select("g", "at", "v", "low").collect()]
    want = [(g, t, v, min((w for h, u, w in rows if h == g and u < t), default=None)) for g, t, v in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
