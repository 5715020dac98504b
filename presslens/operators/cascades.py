"""How a text travels from source to source: likeliest parents, hops, delays, and who leads whom."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.operators.ranges import least_before, running_before
from presslens.scratch import materialize


def carriers(articles: DataFrame, groups: DataFrame, source: str = "source_domain", ts: str = "published_ts", key: str = "article_id") -> DataFrame:
    """(group_id, source, first_at): the second at which each source first has a text of a group. ``groups``: key, group_id.

    Rows without a source or a time are left out; rows without a key are in no group.
    """
    said = articles.select(key, F.col(source).alias("source"), F.unix_timestamp(F.col(ts).cast("timestamp")).alias("first_at"))
    return said.filter("source is not null and first_at is not null").join(groups.select(key, "group_id"), key).groupBy("group_id", "source").agg(F.min("first_at").alias("first_at"))


def with_start(seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``root_at`` and ``sources``: a group's first second and its number of sources."""
    return seen.join(seen.groupBy(*keys).agg(F.min("first_at").alias("root_at"), F.count("*").alias("sources")), list(keys))


def influence(started: DataFrame) -> DataFrame:
    """(source, influence): one, and one more for every group of two sources or more that it is the first of."""
    return started.groupBy("source").agg((1 + F.count_if((F.col("first_at") == F.col("root_at")) & (F.col("sources") > 1))).alias("influence"))


def parents(started: DataFrame, half_life_hours: float = 24.0, keys: Sequence[str] = ("group_id",)) -> DataFrame:
    """Each carrier with its ``parent``: of the group's earlier carriers the likeliest to have been copied.

    An earlier source is copied in proportion to its ``influence``, halved with every half-life that has
    passed since it had the text; ties go to the smaller name. In the logarithm the child's own time is the
    same for all candidates, so the likeliest is a running best over the group's order: no pairs are made,
    and a group with a third of all rows uses many tasks. Carriers of the first second have no parent.
    """
    passed = (F.col("first_at") - F.col("root_at")) / F.lit(half_life_hours * 3600 / math.log(2))
    choice = F.struct((-(F.ln("influence") + passed)).alias("unlikely"), F.col("source").alias("source"), F.col("first_at").alias("first_at"))
    found = least_before(started, "first_at", choice, "chosen", keys)
    return found.withColumn("parent", F.col("chosen.source")).withColumn("delay", F.col("first_at") - F.col("chosen.first_at")).drop("chosen")


def depths(linked: DataFrame) -> DataFrame:
    """``depth`` (hops from the first) and ``root`` by pointer doubling: as many joins as the depth has binary digits."""
    far = materialize(linked.withColumn("up", F.col("parent")).withColumn("root", F.coalesce("parent", "source")).withColumn("depth", F.when(F.col("parent").isNull(), 0).otherwise(1)), "hops")
    while not far.filter("up is not null").isEmpty():
        onward = far.select("group_id", F.col("source").alias("up"), F.col("up").alias("further"), F.col("root").alias("far_root"), F.col("depth").alias("more"))
        leapt = far.join(onward, ["group_id", "up"], "left")
        leapt = leapt.withColumn("root", F.coalesce("far_root", "root")).withColumn("depth", F.col("depth") + F.coalesce("more", F.lit(0))).withColumn("up", F.col("further"))
        far = materialize(leapt.drop("further", "far_root", "more"), "hops")
    return far.drop("up")


def propagation(seen: DataFrame, half_life_hours: float = 24.0) -> DataFrame:
    """(group_id, source, first_at, root_at, sources, influence, parent, delay, root, depth) of every carrier."""
    started = materialize(with_start(seen, ["group_id"]), "started")
    return depths(parents(started.join(influence(started), "source"), half_life_hours))


def summaries(spread: DataFrame, places: Sequence[int] = (2, 5, 10)) -> DataFrame:
    """A row per group: sources, hops of the deepest, mean hops, and the seconds until the k-th source had the text (null: fewer)."""
    placed = running_before(spread, ["first_at", "source"], F.lit(1), "before", ["group_id"])
    until = [F.max(F.when(F.col("before") == k - 1, F.col("first_at") - F.col("root_at"))).alias(f"delay_{k}") for k in places]
    return placed.groupBy("group_id").agg(F.count("*").alias("sources"), F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"), *until)


def _shuffled(started: DataFrame, rounds: int, seed: Column) -> DataFrame:
    """``started``, ``rounds`` times, with the sources of each group dealt anew over its times by the order of a hash."""
    drawn = started.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    drawn = drawn.withColumn("draw", F.md5(F.concat_ws(":", seed, "round", F.col("group_id").cast("string"), "source")))
    sources = running_before(drawn.select("round", "group_id", "draw", "source", "influence"), ["draw", "source"], F.lit(1), "place", ["round", "group_id"])
    times = running_before(started, ["first_at", "source"], F.lit(1), "place", ["group_id"]).select("group_id", "place", "first_at", "root_at")
    return sources.select("round", "group_id", "place", "source", "influence").join(times, ["group_id", "place"])


def leads(seen: DataFrame, half_life_hours: float = 24.0, rounds: int = 19, seed: str = "leads") -> DataFrame:
    """(leader, follower, n, n_back, at_least, p): how often one source copies another, against chance.

    By chance any order of a group's sources is as likely as any other: ``at_least`` is the number of
    ``rounds`` of shuffled orders, by group, with as many copies as ``n`` or more; p = (1 + at_least) / (1 +
    rounds). ``n_back`` counts copies the other way. Groups of one source say nothing and are left out.
    """
    started = with_start(seen, ["group_id"])
    started = materialize(started.join(influence(started), "source").filter("sources > 1"), "started")
    count = lambda df, *by: df.filter("parent is not null").groupBy(*by, F.col("parent").alias("leader"), F.col("source").alias("follower")).agg(F.count("*").alias("n"))
    real = materialize(count(parents(started, half_life_hours)), "leads")
    chance = count(parents(_shuffled(started, rounds, F.lit(seed)), half_life_hours, ["round", "group_id"]), "round").withColumnRenamed("n", "by_chance")
    beaten = real.join(chance, ["leader", "follower"]).groupBy("leader", "follower").agg(F.count_if(F.col("by_chance") >= F.col("n")).alias("at_least"))
    back = real.select(F.col("follower").alias("leader"), F.col("leader").alias("follower"), F.col("n").alias("n_back"))
    both = real.join(beaten, ["leader", "follower"], "left").join(back, ["leader", "follower"], "left").fillna(0, ["at_least", "n_back"])
    return both.withColumn("p", (1 + F.col("at_least")) / F.lit(1 + rounds))
