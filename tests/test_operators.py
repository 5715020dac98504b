import math

import pytest
from pyspark.sql import functions as F

from presslens.functions import urls, weights
from presslens.operators import api, evidence, gold, graph, models, quality, silver, validation, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_urls(spark):
    df = frame(spark, [("https://www.A.com/x/?q=1#f",), ("http://m.b.org",), (None,)], "u string")
    got = df.select(urls.normalize_url(F.col("u")).alias("n"), urls.url_domain(F.col("u")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("a.com/x", "a.com"), ("b.org", "b.org"), (None, None)]


def test_weights_stay_positive(spark):
    df = frame(spark, [(3, 2, -10.0, 90.0), (1, 1, 10.0, -90.0), (0, 0, 0.0, 0.0)], "num_mentions long, num_sources long, goldstein double, avg_tone double")
    w = [r["w"] for r in df.select(weights.event_weight().alias("w")).collect()]
    assert w[0] > 0 and w[1] > w[0] / 10 and w[2] == 0
    assert weights.tau(14) == pytest.approx(14 / math.log(2))


def test_alias_intervals_are_half_open_and_never_multiply(spark):
    alias = frame(spark, [("X", "E1", "2000-01-01", "2001-01-01", 1.0), ("X", "E2", "2001-01-01", None, 0.9), ("Y", "A", "2000-01-01", None, 0.5), ("Y", "B", "2000-01-01", None, 0.6)], "alias_text string, entity_id string, f string, t string, confidence double").select("alias_text", "entity_id", F.col("f").cast("date").alias("valid_from"), F.col("t").cast("date").alias("valid_to"), "confidence")
    rows = frame(spark, [(1, "X", "2000-12-31"), (2, "X", "2001-01-01"), (3, "Y", "2002-01-01"), (4, "USA", "2002-01-01"), (5, "zz", "2002-01-01"), (6, None, None)], "id long, said string, d string").withColumn("d", F.col("d").cast("date"))
    got = {r["id"]: (r["entity_id"], r["entity_status"]) for r in silver.resolve_entities(rows, alias, "id", "said", "d").collect()}
    assert got == {1: ("E1", "RESOLVED"), 2: ("E2", "RESOLVED"), 3: (None, "AMBIGUOUS"), 4: (None, "RAW_ONLY"), 5: (None, "UNKNOWN"), 6: (None, "UNKNOWN")}


def series(spark, values, start="2020-01-01"):
    return frame(spark, list(enumerate(values)), "i int, v double").select(F.lit("e").alias("entity_id"), F.date_add(F.lit(start).cast("date"), F.col("i")).alias("date"), "v")


def test_rolling_and_decay_by_hand(spark):
    df = series(spark, [1.0, 2.0, 3.0, 4.0, 5.0]).filter("v <> 3")
    rolled = [r["r"] for r in windows.rolling_sum(df, ["entity_id"], "v", 2, "r").orderBy("date").collect()]
    assert rolled == [1, 3, 4, 9]
    decayed = [r["d"] for r in windows.decay_sum(df, ["entity_id"], "v", "d", half_life=1.0).orderBy("date").collect()]
    assert decayed == pytest.approx([1, 2.5, 4 + 0.625, 5 + 4.625 / 2])
    long = series(spark, [1.0] * 1500)
    assert windows.decay_sum(long, ["entity_id"], "v", "d", half_life=1.0).orderBy(F.desc("date")).first()["d"] == pytest.approx(2.0)


def test_seasonal_z_looks_back_only(spark):
    values = [float(i % 2) for i in range(400)]
    values[300] = 50.0
    got = [r["zscore"] for r in windows.seasonal_z(series(spark, values), ["entity_id"], "v").orderBy("date").collect()]
    assert all(z is None for z in got[:97]) and got[97] is not None
    assert got[300] > 50 and abs(got[305]) < 2 and got[309] == pytest.approx(got[309])


def test_source_diversity(spark):
    df = frame(spark, [("k", s) for s in "aabc"], "k string, source_domain string")
    assert gold.source_diversity(df, ["k"]).first()["source_diversity"] == pytest.approx(16 / 6)


def test_bh(spark):
    df = frame(spark, [(i, "f", p) for i, p in enumerate([0.01, 0.02, 0.03, 0.04, 0.5])], "id int, family string, p double")
    assert [r["q"] for r in validation.bh_fdr(df, "family", "p", "id").orderBy("id").collect()] == pytest.approx([0.05] * 4 + [0.5])


def test_two_way_effects_recover_the_slope(spark):
    rows = [(f"e{i}", d, float((i * 7 + d * d) % 5), 2.0 * ((i * 7 + d * d) % 5) + 10 * i + 3 * d) for i in range(3) for d in range(6) if (i, d) != (1, 2)]
    fit = models.panel_ols(frame(spark, rows, "entity_id string, date int, x double, y double"), "y", ["x"])
    assert fit.coef[0] == pytest.approx(2.0, abs=1e-6)


def test_normal_p(spark):
    df = frame(spark, [(t / 10,) for t in range(-50, 51)], "t double")
    for r in df.select("t", models.normal_p(F.col("t")).alias("p")).collect():
        assert r["p"] == pytest.approx(math.erfc(abs(r["t"]) / math.sqrt(2)), abs=1e-6)


def test_negbin_finds_the_rate(spark):
    rows = [(float(3 * e if x else e), float(x), float(e)) for e in (1, 2, 4, 8) for x in (0, 1)] * 5
    fit = models.negbin(frame(spark, rows, "y double, x double, e double"), "y", ["x"], "e", kappa=10.0)
    assert fit.coef == pytest.approx((0.0, math.log(3)), abs=1e-6)


def test_placebo_keeps_the_distribution_and_repeats(spark):
    df = series(spark, [float(i) for i in range(30)])
    a = validation.placebo(df, "v", ["date"], 3, 1).orderBy("run_id", "date").collect()
    assert a == validation.placebo(df.repartition(4), "v", ["date"], 3, 1).orderBy("run_id", "date").collect()
    for run in range(3):
        mine = [r for r in a if r["run_id"] == run]
        assert sorted(r["x_placebo"] for r in mine) == [float(i) for i in range(30)] and any(r["x_placebo"] != r["v"] for r in mine)
    with pytest.raises(ValueError, match="20"):
        validation.placebo(df, "v", ["date"], 21, 1)


def test_stance(spark):
    said = frame(spark, [("rate cut expected",), ("rate cut unlikely",), ("inflation falling",), ("inflation remains high",), ("nothing",)], "s string")
    assert [r[0] for r in said.select(evidence.stance(F.col("s"))).collect()] == [-1, 1, -1, 1, 0]


def test_evidence_search_finds_a_literal_row(spark):
    df = frame(spark, [(1, "Central bank warns of currency crisis", "2024-01-02"), (2, "Sports results", "2024-01-02"), (3, "currency", "2025-01-01")], "article_id int, text string, t string").withColumn("published_ts", F.col("t").cast("timestamp"))
    assert [r["article_id"] for r in evidence.search_evidence(df, ["currency"], "2024-01-01", "2024-12-31", 5).collect()] == [1]


def test_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base.upper()), (3, base + " more"), (4, " ".join(f"z{i}" for i in range(60))), (5, None)]
    got = {r["article_id"]: r["group_id"] for r in evidence.near_copies(frame(spark, rows, "article_id long, text string")).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == 4


def test_graph(spark):
    edges = frame(spark, [("a", "b", 1.0), ("b", "a", 1.0), ("c", "a", 2.0), ("d", "e", 5.0)], "src_entity_id string, dst_entity_id string, weight double")
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(edges, 30).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and ranks["a"] > ranks["c"]
    pairs = edges.withColumnRenamed("weight", "tension")
    assert {r["node"]: r["label"] for r in graph.tension_clusters(pairs, 1.0).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    groups = {r["node"]: r["label"] for r in graph.communities(edges).collect()}
    assert groups["d"] == groups["e"] != groups["a"]
    chain = frame(spark, [(i, i + 1) for i in range(40)], "a int, b int")
    assert {r["label"] for r in graph.min_labels(chain).collect()} == {0}


@pytest.mark.parametrize(("bad", "good"), [(-1, 0), (200, 50)])
def test_checks_catch_planted_faults(spark, bad, good):
    df = frame(spark, [(1, float(good)), (2, float(bad))], "id int, v double")
    (r,) = quality.check_none(df, ~F.col("v").between(0, 100), "range").collect()
    assert (r["check_id"], r["passed"], r["value"]) == ("range", False, 1.0)
    assert quality.check_none(df.filter("id = 1"), ~F.col("v").between(0, 100), "range").first()["passed"]
    assert not quality.check_unique(df.unionByName(df), ["id"]).first()["passed"]
    assert not quality.check_rows(df.limit(0)).first()["passed"]


def test_guards():
    api.guard("2020-01-01", "2020-12-31", ["a"])
    for start, end, names in [("2020-01-01", "2019-01-01", []), ("2000-01-01", "2020-01-01", []), ("2020-01-01", "2020-01-02", ["x"] * 101)]:
        with pytest.raises(ValueError, match="asked for"):
            api.guard(start, end, names)


def test_known_signal_is_supported_and_noise_is_not(spark):
    base = {"mapping_ok": True, "data_ok": True, "feature_ok": True, "cost_ok": True, "expected_sign": -1.0, "r2_train": 0.2, "slices_passed": 3, "folds_positive": 4}
    signal = base | {"run_id": 1, "q": 0.01, "sign": -1.0, "sign_stability": 1.0, "r2_oos": 0.1, "placebo_p": 0.01}
    noise = base | {"run_id": 2, "q": 0.6, "sign": 1.0, "sign_stability": 0.5, "r2_oos": -0.1, "placebo_p": 0.5, "folds_positive": 0}
    one_slice = signal | {"run_id": 3, "slices_passed": 1}
    got = {r["run_id"]: (r["v"], r["why"]) for r in spark.createDataFrame([signal, noise, one_slice]).select("run_id", validation.decide().alias("v"), validation.failure_reason().alias("why")).collect()}
    assert got == {1: ("supported", None), 2: ("rejected", "no_signal"), 3: ("inconclusive", None)}


def test_ranks_over_ranges_match_a_whole_window(spark):
    from presslens.operators.ranges import running_before

    df = spark.range(500).select((F.col("id") * 37 % 101).alias("k"), F.col("id"), (F.col("id") % 2).alias("g")).repartition(4)
    got = {r["id"]: r["n"] for r in running_before(df, ["k", "id"], F.col("k"), "n", ["g"]).collect()}
    for g in (0, 1):
        total = 0
        for k, i in sorted((i * 37 % 101, i) for i in range(500) if i % 2 == g):
            assert got[i] == total
            total += k


def test_similar_articles_in_blocks(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0]), (63, [None, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in evidence.similar_articles(df, df.filter("vec_id % 20 = 0"), 4, asked=2, held=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for q in (0, 20, 40):
        best = sorted((-round(cos(rows[q][1], v), 12), i) for i, v in rows[:60] if i != q)[:4]
        assert {i for _, i in got[q]} <= {i for i, v in rows[:60] if round(cos(rows[q][1], v), 9) >= round(-best[-1][0], 9)} and len(got[q]) == 4
    assert 60 not in got


def test_only_registered_relations_by_theme(spark):
    with pytest.raises(ValueError, match="unknown relations"):
        silver.map_relation_by_theme(spark.createDataFrame([("a", "unknown")], "theme_id string, relation_id string"), {"a": "no_such"})
