import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from presslens.llm import quality_vote as qv


def plain_vector(text, idf):
    """The same features from plain Python."""
    counts = Counter(((int.from_bytes(text[i : i + 3], "big") * 2654435761) % 2**32) >> 20 for i in range(len(text) - 2))
    v = [math.log1p(counts[g]) * idf[g] for g in range(4096)]
    norm = math.sqrt(sum(a * a for a in v)) or 1.0
    words, n = text.split(), max(len(text), 1)
    upper, odd = sum(65 <= c <= 90 for c in text), sum(c in b"#*$%&|<>!=@^~_{}[]\\/+" for c in text)
    levels = [int(math.log2(1 + len(words)) * 0.75), int(math.log2(1 + len(text) / (1 + text.count(b"\n"))) * 0.9)]
    levels += [int(s * 12) for s in (odd / n * 3, upper / n * 3, len(set(words)) / max(len(words), 1) * 0.999, min(n / max(len(words), 1) / 16, 0.999))]
    v = [a / norm for a in v] + [0.0] * 72
    for i, level in enumerate(levels):
        v[4096 + 12 * i + min(level, 11)] = 0.35
    norm = math.sqrt(sum(a * a for a in v))
    return np.array([a / norm for a in v])


def test_scores_match_voting_among_plain_vectors(spark):
    """As many labels as dimensions, so that the space is all that the labelled vectors span: no decomposition is taken over from the operator."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = {r["doc_id"]: r["score"] for r in qv.score_documents(docs, qv.fit(docs, labels, most=qv.DIMENSIONS)).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    seen = Counter(g for t in texts.values() for g in {((int.from_bytes(t[i : i + 3], "big") * 2654435761) % 2**32) >> 20 for i in range(len(t) - 2)})
    idf = [math.log((1 + len(texts)) / (1 + seen[g])) + 0.05 for g in range(4096)]
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["quality"] is not None and r["doc_id"] in texts}
    order = spark.createDataFrame([(k,) for k in known], "k long").orderBy(F.xxhash64("k"), "k").limit(qv.DIMENSIONS).collect()
    chosen = [r["k"] for r in order]
    x = np.array([plain_vector(texts[k], idf) for k in chosen])
    span = np.linalg.svd(x, full_matrices=False)
    span = span[2][span[1] > 1e-9 * span[1][0]]
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    own, y = unit(x @ span.T), np.array([float(known[k]) for k in chosen])
    assert 0 < y.mean() < 1
    for k, t in texts.items():
        cos = own @ unit(plain_vector(t, idf) @ span.T)
        near = np.argsort(-cos, kind="stable")[: qv.NEIGHBOURS]
        if np.sort(cos)[-qv.NEIGHBOURS] - np.sort(cos)[-qv.NEIGHBOURS - 1] < 1e-9:
            continue  # a tie for the last place
        w = np.maximum(cos[near], 1e-3) ** qv.SHARPNESS
        assert abs(got[k] - (w * y[near]).sum() / w.sum()) < 1e-6


def test_a_repeated_document_counts_as_one_label(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20)) + " !" * (i % 7)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    many = docs.unionByName(spark.createDataFrame([(1, texts[1][1])], "doc_id long, text string").join(spark.range(3000)).drop("id"))
    model = qv.fit(many, labels, most=150)
    assert len(model.labels) == 150 and abs(model.labels.mean() - 0.5) < 0.15
    assert (model.labels == qv.fit(docs, labels, most=150).labels).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = qv.op8_quality_vote(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.92
    assert docs.count() == qv.op8_quality_vote(spark, "/root/testdata/sf0.01").count()


def test_document_frequencies_cover_all_rows(spark):
    rows = [(1, "abc"), (2, "abcabc"), (3, None), (4, "ab"), (5, "xyz")]
    n, total = qv.document_frequencies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert total == 5
    want = sum((qv.grams((t or "").encode()) > 0).astype(int) for _, t in rows)
    assert (n == want).all()


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "good text"), (1, "good text"), (2, None), (3, ""), (None, "x"), (4, "w " * 60_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in qv.score_documents(docs, qv.fit(docs, no_labels)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1)], "doc_id long, quality int")
    scores = qv.score_documents(docs, qv.fit(docs, one)).collect()
    assert len(scores) == 6 and all(0 <= r["score"] <= 1 for r in scores)
    assert qv.score_documents(docs.limit(0), qv.fit(docs.limit(0), one)).count() == 0
