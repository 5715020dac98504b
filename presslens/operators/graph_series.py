"""The graph of each period: ranks, communities and clusters of all periods in one loop, and their identity over time."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslens.operators.graph import min_labels
from presslens.scratch import materialize as written


def until_settled(start: DataFrame, step: Callable[[DataFrame], DataFrame], period: str, tolerance: float, rounds: int, what: str) -> DataFrame:
    """``step`` gives the rows of the periods that are still moving, with ``moved`` for each; a period leaves once all of its rows moved by ``tolerance`` at most.

    Each round is one written table; the driver only learns whether a period is left.
    """
    active, done = start, None
    for _ in range(rounds):
        new = written(step(active), what)
        left = written(new.groupBy(period).agg(F.max("moved").alias("most")).filter(F.col("most") > tolerance).select(period), "moving")
        settled = new.join(left, period, "left_anti").drop("moved")
        done = settled if done is None else done.unionByName(settled)
        active = new.join(left, period, "left_semi").drop("moved")
        if left.isEmpty():
            return written(done, what)
    warnings.warn(f"{what} of {left.count()} periods still moved after {rounds} rounds", stacklevel=3)
    return written(done.unionByName(active), what)


def pagerank_series(edges: DataFrame, period: str = "month", damping: float = 0.85, weight: str = "weight", tolerance: float = 1e-13, rounds: int = 400) -> DataFrame:
    """(period, node, rank): ranks of each period add up to 1. What nodes without outgoing edges hold is spread evenly over the period's nodes."""
    kept = edges.filter(F.col(weight) > 0).groupBy(period, "src_entity_id", "dst_entity_id").agg(F.sum(weight).alias("w"))
    total = kept.groupBy(period, "src_entity_id").agg(F.sum("w").alias("out"))
    links = written(kept.join(total, [period, "src_entity_id"]).select(period, "src_entity_id", "dst_entity_id", (F.col("w") / F.col("out")).alias("p")), "links")
    nodes = links.select(period, F.explode(F.array("src_entity_id", "dst_entity_id")).alias("node")).distinct()
    sizes = nodes.groupBy(period).agg(F.count(F.lit(1)).alias("size"))
    start = written(nodes.join(sizes, period).withColumn("rank", 1 / F.col("size")), "ranks")

    def step(ranks: DataFrame) -> DataFrame:
        gives = ranks.select(period, F.col("node").alias("src_entity_id"), "rank").join(links, [period, "src_entity_id"]).groupBy(period, F.col("dst_entity_id").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        got = ranks.join(gives, [period, "node"], "left").fillna(0.0, ["got"])
        lost = got.groupBy(period).agg((1 - F.sum("got")).alias("lost"))
        new = (1 - damping) / F.col("size") + damping * (F.col("got") + F.col("lost") / F.col("size"))
        return got.join(lost, period).select(period, "node", "size", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved"))

    return until_settled(start, step, period, tolerance, rounds, "ranks").drop("size")


def communities_series(edges: DataFrame, period: str = "month", weight: str = "weight", rounds: int = 100) -> DataFrame:
    """(period, node, label): label propagation in each period until no label moves. As ``graph.communities``, and with each period's modularity."""
    ends = [F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("src_entity_id", "dst_entity_id"), ("dst_entity_id", "src_entity_id"))]
    both = edges.filter((F.col("src_entity_id") != F.col("dst_entity_id")) & (F.col(weight) > 0)).select(period, F.explode(F.array(*ends)).alias("e"), F.col(weight).alias("w")).select(period, "e.a", "e.b", "w")
    links = written(both.groupBy(period, "a", "b").agg(F.sum("w").alias("w")), "links")
    own = written(links.groupBy(period, F.col("a").alias("node")).agg(F.max("w").alias("w")), "own")
    start = own.select(period, "node", F.col("node").alias("label"))

    def step(labels: DataFrame) -> DataFrame:
        said = links.join(labels.select(period, F.col("node").alias("b"), "label"), [period, "b"]).select(period, F.col("a").alias("node"), "label", "w")
        votes = said.unionByName(labels.join(own, [period, "node"]).select(period, "node", "label", "w")).groupBy(period, "node", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy(period, "node").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("best")).select(period, "node", F.col("best.label").alias("new"))
        return labels.join(best, [period, "node"]).select(period, "node", F.col("new").alias("label"), (F.col("new") != F.col("label")).cast("double").alias("moved"))

    labels = until_settled(start, step, period, 0.0, rounds, "labels")
    la, lb = labels.select(period, F.col("node").alias("a"), F.col("label").alias("la")), labels.select(period, F.col("node").alias("b"), F.col("label").alias("lb"))
    met = links.join(la, [period, "a"]).join(lb, [period, "b"])
    groups = met.groupBy(period, F.col("la").alias("label")).agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)).alias("inside"))
    whole = groups.groupBy(period).agg(F.sum("degree").alias("all"), F.sum("inside").alias("inside"), F.sum(F.col("degree") * F.col("degree")).alias("squares"))
    quality = whole.select(period, (F.col("inside") / F.col("all") - F.col("squares") / (F.col("all") * F.col("all"))).alias("modularity"))
    return labels.join(quality, period)


def clusters_series(pairs: DataFrame, threshold: float, period: str = "month", value: str = "tension") -> DataFrame:
    """(period, node, label): connected sets of pairs at ``threshold`` or more in each period; the label is the smallest node."""
    hot = pairs.filter((F.col(value) >= threshold) & (F.col("src_entity_id") != F.col("dst_entity_id")))
    end = lambda c: F.struct(F.col(period).alias("p"), F.col(c).alias("n"))
    found = min_labels(hot.select(end("src_entity_id").alias("a"), end("dst_entity_id").alias("b")).distinct())
    return found.select(F.col("node.p").alias(period), F.col("node.n").alias("node"), F.col("label.n").alias("label"))


def lineages(groups: DataFrame, before: str, period: str = "month") -> DataFrame:
    """``groups`` (period, node, label) with ``lineage`` and ``age``: the first group of the chain that a group continues, and periods since.

    ``before`` is SQL for the period before ``period``. A group continues the one of the period before with which it shares most
    nodes (of equals, the smallest label), if that one's own largest share goes to it too. Chains are followed by pointer doubling.
    """
    now = groups.select(period, "label", "node")
    then = groups.select(F.col(period).alias("was"), F.col("label").alias("old"), "node")
    shared = now.withColumn("was", F.expr(before)).join(then, ["was", "node"]).groupBy(period, "label", "was", "old").agg(F.count(F.lit(1)).alias("n"))
    up, down = Window.partitionBy(period, "label").orderBy(F.desc("n"), "old"), Window.partitionBy("was", "old").orderBy(F.desc("n"), "label")
    mutual = shared.withColumns({"u": F.row_number().over(up), "d": F.row_number().over(down)}).filter("u = 1 and d = 1")
    key = lambda p, c: F.struct(F.col(p).alias("p"), F.col(c).alias("l"))
    ids = groups.select(key(period, "label").alias("id")).distinct()
    at = written(ids.join(mutual.select(key(period, "label").alias("id"), key("was", "old").alias("to")), "id", "left").select("id", F.coalesce("to", "id").alias("root"), F.col("to").isNotNull().cast("long").alias("age")), "lineages")
    while True:
        beyond = at.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("age").alias("more"))
        new = written(at.join(beyond, "root").select("id", F.col("next").alias("root"), (F.col("age") + F.col("more")).alias("age"), (F.col("more") > 0).alias("moved")), "lineages")
        at = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    named = at.select(F.col("id.p").alias(period), F.col("id.l").alias("label"), F.concat_ws("|", F.col("root.p").cast("string"), F.col("root.l")).alias("lineage"), "age")
    return groups.join(named, [period, "label"])
