import numpy as np
from pyspark.sql import functions as F

from presslens.llm import ann


def exact(rows, queries, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, qv in good:
        if q in queries:
            scored = sorted({(-(qv * v).sum() / np.sqrt((qv * qv).sum() * (v * v).sum()), i) for i, v in good if i != q})
            out[q] = [i for _, i in scored[:k]]
    return out


def test_finds_neighbours_with_calibrated_recall(spark):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((30, 8))
    rows = [(i, (centers[i % 30] + 0.4 * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("leaf", F.lit("clash")).repartition(4)
    got = ann.search(df, F.pmod(F.col("vec_id"), F.lit(20)) == 0).collect()
    want = exact(rows, set(range(0, 3000, 20)))
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
    hits = sum(len({r["vec_id"] for r in found[q]} & set(want[q])) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    v = {i: np.array(x, float) for i, x in rows}
    for q, rs in found.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == [1, 2, 3, 4, 5] and q not in {r["vec_id"] for r in rs}
        assert [(-r["score"], r["vec_id"]) for r in rs] == sorted((-r["score"], r["vec_id"]) for r in rs)
        for r in rs:
            a, b = v[q], v[r["vec_id"]]
            assert abs(r["score"] - (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())) < 1e-12


def test_unusable_vectors_ties_and_copies(spark):
    one = [1.0] + [0.0] * 7
    rows = [(0, one), (20, one), (20, one), *[(7, one)] * 9, *[(i, one) for i in range(1, 12)], (30, [2.0] + [0.0] * 7), (40, None), (41, [0.0] * 8), (42, [float("nan")] * 8), (43, [None] * 8), (44, [1.0, 2.0]), (None, one), (45, [float("inf")] * 8), (60, [0.0, 1.0] + [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == exact(rows, {0, 20, 40, 60})
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df, F.lit(False)).count() == 0
    assert ann.search(df.filter("vec_id in (0, 1)"), F.col("vec_id") == 0).count() == 1


def test_blocks_of_a_hot_leaf_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, (np.ones(8) + 1e-3 * rng.standard_normal(8)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "GROUP", 4)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, recall=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    want = exact(rows, set(range(0, 400, 20)))
    assert sum([i for _, i in sorted(got[q])] == want[q] for q in want) >= 0.9 * len(want)


def test_rows_that_share_an_id_are_all_candidates(spark):
    v = lambda x, y: [x, y] + [0.0] * 6
    rows = [(0, v(1.0, 0.0)), (7, v(1.0, 0.1)), (7, v(0.1, 1.0)), (7, v(0.1, 1.0)), (20, v(0.0, 1.0)), (20, v(1.0, 1.0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault((r["query_id"], r["query_vector"]), []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    cosine = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    want = []
    for q, qv in (rows[0], rows[4], rows[5]):
        near = sorted({(-cosine(qv, w), i, tuple(w)) for i, w in rows if i != q})
        want.append((q, [(n + 1, i, -s) for n, (s, i, _) in enumerate(near[:5])]))
    assert sorted((q, sorted(x)) for (q, _), x in got.items()) == sorted(want)
    assert (1, 7, cosine(rows[0][1], rows[1][1])) in got[next(k for k in got if k[0] == 0)]


def test_recall_on_the_given_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asks = F.pmod(F.col("vec_id"), F.lit(50)) == 0
    got = {}
    for r in ann.search(df, asks).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    table = df.select("vec_id", "embedding").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -2
        hits += len(got[ids[q]] & set(ids[np.argsort(-s)[:5]].tolist()))
    assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()


def test_queries_among_lone_leaves_find_all_that_they_should(spark, monkeypatch):
    """Leaves of a single row and one visit by calibration: visits are widened until there are k candidates."""
    monkeypatch.setattr(ann, "LEAF", 1)
    monkeypatch.setattr(ann, "RECALL", 0.05)
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)] + [(7, [float(x) for x in rng.normal(size=6)]) for _ in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 7 == 0, recall=0.05).groupBy("query_id", "query_vector").count().collect()
    assert len(got) == 12 and {r["count"] for r in got} == {5}
    few = ann.search(df.filter("vec_id < 4"), F.col("vec_id") == 0, recall=0.05).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3]
