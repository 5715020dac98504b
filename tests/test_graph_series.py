import datetime as dt
import random

import numpy as np
import pytest

from presslens.operators import graph, graph_series


def month(i):
    return dt.date(2020 + i // 12, i % 12 + 1, 1)


def made(spark, months=4, nodes=9, seed=3):
    rng = random.Random(seed)
    rows = [(month(m), f"N{a}", f"N{b}", rng.random()) for m in range(months) for a in range(nodes) for b in range(nodes) if a != b and rng.random() < 0.35 and not (m == 2 and a == 0)]
    return rows, spark.createDataFrame(rows, "month date, src_entity_id string, dst_entity_id string, weight double")


def test_ranks_are_the_fixed_point_of_each_month(spark):
    rows, df = made(spark)
    got = graph_series.pagerank_series(df).collect()
    for m in range(4):
        edges = [(a, b, w) for p, a, b, w in rows if p == month(m)]
        names = sorted({x for a, b, _ in edges for x in (a, b)})
        p = np.zeros((len(names), len(names)))
        for a, b, w in edges:
            p[names.index(b), names.index(a)] += w
        out = p.sum(axis=0)
        p = np.where(out > 0, p / np.where(out > 0, out, 1), 1 / len(names))
        full = 0.85 * p + 0.15 / len(names)
        values, vectors = np.linalg.eig(full)
        v = np.real(vectors[:, np.argmax(np.real(values))])
        mine = {r["node"]: r["rank"] for r in got if r["month"] == month(m)}
        assert [mine[n] for n in names] == pytest.approx(list(v / v.sum()), abs=1e-8)
    assert graph_series.pagerank_series(df.limit(0)).count() == 0
    with pytest.warns(UserWarning, match="still moved"):
        assert graph_series.pagerank_series(df, rounds=2).count() == len(got)


def test_communities_equal_those_of_each_month_alone_and_modularity(spark):
    rows = [(month(m), f"{g}{a}", f"{g}{b}", 1.0) for m in range(2) for g in "xy" for a in range(4) for b in range(a)] + [(month(m), "x0", "y0", 0.1) for m in range(2)]
    df = spark.createDataFrame(rows, "month date, src_entity_id string, dst_entity_id string, weight double")
    got = {(r["month"], r["node"]): r for r in graph_series.communities_series(df).collect()}
    assert {r["label"] for r in got.values() if r["node"][0] == "x"} != {r["label"] for r in got.values() if r["node"][0] == "y"} and len(got) == 16
    alone = {r["node"]: r["label"] for r in graph.communities(df.filter("month = '2020-01-01'"), rounds=30).collect()}
    assert {n: got[month(0), n]["label"] for n in alone} == alone
    w, inside = 24.2, 24.0
    assert got[month(0), "x0"]["modularity"] == pytest.approx(inside / w - 2 * (12.1 / w) ** 2)


def test_clusters_and_lineages(spark):
    member = {0: [["a", "b", "c"], ["p", "q"]], 1: [["b", "c", "d"], ["p", "q", "r", "s"]], 2: [["b", "c", "d", "p", "q", "r", "s"]], 3: [["p", "q", "s"], ["b", "c"]], 5: [["b", "c"]]}
    pairs = [(month(m), g[i], g[i + 1], 5.0) for m, gs in member.items() for g in gs for i in range(len(g) - 1)] + [(month(0), "a", "p", 1.0), (month(0), "z", "z", 9.0)]
    found = graph_series.clusters_series(spark.createDataFrame(pairs, "month date, src_entity_id string, dst_entity_id string, tension double"), 2.0)
    assert {(r["month"], r["node"], r["label"]) for r in found.collect()} == {(month(m), n, min(g)) for m, gs in member.items() for g in gs for n in g}
    got = {(r["month"], r["label"]): (r["lineage"], r["age"]) for r in graph_series.lineages(found, "add_months(month, -1)").collect()}
    assert got[month(1), "b"] == ("2020-01-01|a", 1) and got[month(1), "p"] == ("2020-01-01|p", 1)
    assert got[month(2), "b"] == ("2020-01-01|p", 2)  # four of its seven nodes were in that one
    assert got[month(3), "p"] == ("2020-01-01|p", 3) and got[month(3), "b"] == ("2020-04-01|b", 0)
    assert got[month(5), "b"] == ("2020-06-01|b", 0)
