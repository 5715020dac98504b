"""Operators on the monthly graph of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.scratch import materialize as written


def strength(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """(node, out_strength, in_strength)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src_entity_id").alias("node"), F.col(weight).alias("o"), F.lit(0.0).alias("i")), F.struct(F.col("dst_entity_id").alias("node"), F.lit(0.0).alias("o"), F.col(weight).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("out_strength"), F.sum("e.i").alias("in_strength"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, weight: str = "weight") -> DataFrame:
    """(node, rank), ranks adding up to 1. What nodes without outgoing edges hold is spread evenly."""
    total = edges.groupBy("src_entity_id").agg(F.sum(weight).alias("out"))
    links = written(edges.filter(F.col(weight) > 0).join(total, "src_entity_id").select("src_entity_id", "dst_entity_id", (F.col(weight) / F.col("out")).alias("p")), "links")
    nodes = written(links.select(F.explode(F.array("src_entity_id", "dst_entity_id")).alias("node")).distinct(), "nodes")
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        gives = ranks.join(links, F.col("node") == F.col("src_entity_id")).groupBy("dst_entity_id").agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        got = nodes.join(gives, F.col("node") == F.col("dst_entity_id"), "left").select("node", F.coalesce("got", F.lit(0.0)).alias("got"))
        rest = got.agg((1 - F.sum("got")).alias("lost"))  # one row
        ranks = got.join(F.broadcast(rest)).select("node", ((1 - damping) / n + damping * (F.col("got") + F.col("lost") / n)).alias("rank"))
        if i % 5 == 4:
            ranks = written(ranks, "ranks")
    return ranks


def communities(edges: DataFrame, rounds: int = 8, weight: str = "weight") -> DataFrame:
    """Label propagation: each node takes the label of most weight around it; ties to the smaller label.

    Its own label counts as much as its strongest link, so that two nodes don't swap labels for ever.
    """
    both = edges.select(F.col("src_entity_id").alias("a"), F.col("dst_entity_id").alias("b"), weight).unionByName(edges.select(F.col("dst_entity_id").alias("a"), F.col("src_entity_id").alias("b"), weight))
    links = written(both.filter("a <> b").groupBy("a", "b").agg(F.sum(weight).alias("w")), "links")
    labels = links.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    own = links.groupBy("a").agg(F.max("w").alias("w")).withColumnRenamed("a", "node")
    for _ in range(rounds):
        said = links.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label", "w").unionByName(labels.join(own, "node").select("node", "label", "w"))
        votes = said.groupBy("node", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("node").agg(F.max("w").alias("top")).withColumnRenamed("node", "n")
        labels = written(votes.join(best, (F.col("node") == F.col("n")) & (F.col("w") >= F.col("top"))).groupBy("node").agg(F.min("label").alias("label")), "labels")
    return labels


def min_labels(pairs: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected set of pairs (a, b). Labels spread to neighbours and jump to their own label until none moves."""
    links = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(links.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = links.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        moved = written(spread.join(jump, F.col("next") == F.col("at"), "left").select("node", "label", F.least("next", F.coalesce("beyond", "next")).alias("next")), "labels")
        labels = moved.select("node", F.col("next").alias("label"))
        if moved.filter("next <> label").isEmpty():
            return labels


def tension_clusters(pairs: DataFrame, threshold: float, value: str = "tension") -> DataFrame:
    hot = pairs.filter((F.col(value) >= threshold) & (F.col("src_entity_id") != F.col("dst_entity_id")))
    return min_labels(hot.select(F.col("src_entity_id").alias("a"), F.col("dst_entity_id").alias("b")).distinct())


def narrative_similarity(themes: DataFrame, entity: str = "entity_id", theme: str = "theme_id", value: str = "value") -> DataFrame:
    """(a, b, similarity): cosine of theme vectors of entities that share a theme. Entities are a universe of at most some hundreds."""
    sums = themes.groupBy(entity, theme).agg(F.sum(value).alias("v"))
    norms = sums.groupBy(entity).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    left = sums.select(F.col(entity).alias("a"), theme, F.col("v").alias("va"))
    right = sums.select(F.col(entity).alias("b"), theme, F.col("v").alias("vb"))
    dots = left.join(right, theme).filter("a < b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    na, nb = norms.select(F.col(entity).alias("a"), F.col("norm").alias("na")), norms.select(F.col(entity).alias("b"), F.col("norm").alias("nb"))
    return dots.join(na, "a").join(nb, "b").select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("similarity"))
