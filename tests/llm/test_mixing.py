import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from presslens.llm import mixing


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def copies(key, text, rate):
    key = f"{'null' if key is None else key}:{hashlib.md5((text or '').encode()).hexdigest()}"
    pieces = max(math.ceil(rate / mixing.PIECE), 1)
    total, mean = 0, rate / pieces
    for i in range(1, pieces + 1):
        u, k, p = uniform(mixing.SEED, "count", key, i), 0, math.exp(-mean)
        c = p
        while c <= u and k < mixing.TERMS:
            k += 1
            p *= mean / k
            c += p
        total += k + (c <= u)
    return total


def test_counts_are_the_inverted_poisson_distribution(spark):
    rows = [(i, "a", "x" * 9) for i in range(300)] + [(1000, "b", "y" * 9), (1001, None, "z" * 19), (None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("rate", F.lit("clash"))
    got = mixing.mix(docs)
    assert got.columns == [*docs.columns, "mix_copy", "mix_rate", "mix_order"]
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(t or "") + 1
    total = sum(sizes.values())
    seen = Counter(r["doc_id"] for r in got.collect())
    for i, s, t in rows:
        assert seen[i] == copies(i, t, total / 3 / sizes[s]), i
    assert max(r["mix_rate"] for r in got.collect()) > mixing.PIECE  # one source is drawn in pieces


def test_weights_and_empty_tables(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "small").otherwise("large").alias("source"), F.lit("tenletters").alias("text"))
    mixed = mixing.mix(docs, {"small": 3.0, "large": 1.0}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in mixed}
    assert 0.70 < n["small"] / sum(n.values()) < 0.80
    assert mixing.mix(docs, {"small": 1.0}).filter("source = 'large'").count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_salted_join_gives_the_same(spark, monkeypatch):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), F.lit("some text").alias("text"))
    plain = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == plain


def test_rows_without_an_id_draw_on_their_own_and_are_spread(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"), F.lit("a").alias("source"))
    same = spark.range(2000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.lit("b").alias("source"))
    mixed = mixing.mix(docs.unionByName(same), {"a": 3.0, "b": 1.0}).withColumn("at", F.spark_partition_id())
    drawn = Counter(Counter(r["text"] for r in mixed.filter("source = 'a'").collect()).values())
    assert len(drawn) >= 3 and max(drawn.values()) < 2500
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    for source in ("a", "b"):
        rows = [r["count"] for r in mixed.filter(F.col("source") == source).groupBy("at").count().collect()]
        assert not rows or max(rows) < 0.6 * sum(rows)
    spark.conf.set(setting, "true")
