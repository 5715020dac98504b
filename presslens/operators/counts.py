"""Negative binomial counts of relations between entities: sender and receiver effects and a size for each relation.

A cell (relation, sender, receiver, period) has a count with mean exposure x exp(alpha_r + out_ir + in_jr + gamma_r x)
and size kappa_r. There may be millions of effects, so they are tables and are fitted in blocks: given the
others, the effects of one block have score and information that are sums over their own cells. Every block
of every relation is one join and one aggregation with a Newton step in each row; nothing but the largest
step comes to the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.scratch import materialize as written

#: Effects stay this near to their relation's level: an entity without a single event would go to minus infinity.
REACH, LOG_KAPPA, LONGEST = 10.0, (-5.0, 12.0), 2.0
SHIFT = 6


def digamma(x: Column) -> Column:
    """For x > 0, by its series at x + SHIFT; to about 1e-10."""
    z = x + SHIFT
    low = sum((1 / (x + m) for m in range(SHIFT)), F.lit(0.0))
    return F.log(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * z * z * z * z) - 1 / (252 * z * z * z * z * z * z) - low


def trigamma(x: Column) -> Column:
    z = x + SHIFT
    low = sum((1 / ((x + m) * (x + m)) for m in range(SHIFT)), F.lit(0.0))
    return 1 / z + 1 / (2 * z * z) + 1 / (6 * z * z * z) - 1 / (30 * z * z * z * z * z) + 1 / (42 * z * z * z * z * z * z * z) + low


@dataclass(frozen=True)
class CountFit:
    """relations: relation, kappa, const, slopes and their conditional errors, n. effects: relation, kind (out, in), entity, effect."""

    relations: DataFrame
    effects: DataFrame
    rounds: int
    settled: bool


def clipped(step: Column, most: float = LONGEST) -> Column:
    return F.greatest(F.least(step, F.lit(most)), F.lit(-most))


def negbin_effects(
    cells: DataFrame, y: str, exposure: str, relation: str = "relation_id", sender: str = "src_entity_id", receiver: str = "dst_entity_id", xs: Sequence[str] = (), rounds: int = 100, tolerance: float = 1e-4,
) -> CountFit:
    """Fit all relations at once. Cells with a null or without exposure take no part; zero counts have to be there as cells.

    Receiver effects have mean 0 in each relation, and so have sender effects once ``const`` is taken off.
    Warns if steps are still over ``tolerance`` after ``rounds``.
    """
    kept = cells.filter(F.col(exposure) > 0).select(F.col(relation).alias("r"), F.col(sender).alias("i"), F.col(receiver).alias("j"), F.col(y).cast("double").alias("y"), F.col(exposure).cast("double").alias("e"), *[F.col(x).cast("double").alias(f"x{k}") for k, x in enumerate(xs)])
    data = written(kept.dropna(), "cells")
    slopes = [f"g{k}" for k in range(len(xs))]
    level = F.log(F.greatest(F.sum("y"), F.lit(0.5)) / F.sum("e"))
    out = written(data.groupBy("r", "i").agg(level.alias("a")), "out")
    into = written(data.select("r", "j").distinct().withColumn("b", F.lit(0.0)), "in")
    whole = written(data.groupBy("r").agg(F.lit(0.0).alias("log_kappa"), *[F.lit(0.0).alias(g) for g in slopes]), "relations")

    def expected() -> DataFrame:
        """Cells with mu and w, the weight of a unit of eta."""
        eta = F.col("a") + F.col("b") + sum((F.col(g) * F.col(f"x{k}") for k, g in enumerate(slopes)), F.lit(0.0))
        met = data.join(out, ["r", "i"]).join(into, ["r", "j"]).join(whole, "r").withColumns({"mu": F.col("e") * F.exp(F.least(eta, F.lit(50.0))), "kappa": F.exp("log_kappa")})
        return met.withColumns({"w": F.col("mu") / (1 + F.col("mu") / F.col("kappa")), "u": (F.col("y") - F.col("mu")) / (1 + F.col("mu") / F.col("kappa"))})

    def stepped(keys: Sequence[str], effects: DataFrame, name: str, label: str) -> tuple[DataFrame, float]:
        step = F.coalesce(clipped(F.try_divide(F.sum("u"), F.sum("w"))), F.lit(0.0))
        steps = expected().groupBy(*keys).agg(step.alias("step"))
        moved = effects.join(steps, list(keys)).withColumn("free", F.col(name) + F.col("step"))
        middle = F.lit(0.0)
        if name == "a":  # holds the relation's level too
            moved, middle = moved.join(effects.groupBy("r").agg(F.percentile_approx(name, 0.5).alias("middle")), "r"), F.col("middle")
        new = written(moved.withColumn("new", F.greatest(F.least("free", middle + REACH), middle - REACH)).select(*keys, F.col("new").alias(name), F.abs(F.col("new") - F.col(name)).alias("moved")), label)
        return new.drop("moved"), new.agg(F.coalesce(F.max("moved"), F.lit(0.0))).first()[0]

    settled, done, most = data.isEmpty(), 0, 0.0
    while not settled and done < rounds:
        done += 1
        out, first = stepped(["r", "i"], out, "a", "out")
        raw, second = stepped(["r", "j"], into, "b", "in")
        means = raw.groupBy("r").agg(F.avg("b").alias("mean"))
        into = written(raw.join(means, "r").select("r", "j", (F.col("b") - F.col("mean")).alias("b")), "in")
        out = written(out.join(means, "r").select("r", "i", (F.col("a") + F.col("mean")).alias("a")), "out")
        third = 0.0
        for k, g in enumerate(slopes or [None]):
            kappa, mu, n = F.col("kappa"), F.col("mu"), F.col("y")
            score = digamma(n + kappa) - digamma(kappa) + F.log(kappa) + 1 - F.log(kappa + mu) - (n + kappa) / (kappa + mu)
            bend = trigamma(n + kappa) - trigamma(kappa) + 1 / kappa - 1 / (kappa + mu) - (mu - n) / ((kappa + mu) * (kappa + mu))
            x = F.col(f"x{k}") if g else F.lit(0.0)
            sums = expected().groupBy("r").agg(F.sum(score).alias("score"), F.sum(bend).alias("bend"), F.sum(F.col("u") * x).alias("ux"), F.sum(F.col("w") * x * x).alias("wx"))
            slope_step = clipped(F.coalesce(F.try_divide(F.col("ux"), F.col("wx")), F.lit(0.0))) if g else F.lit(0.0)
            near = whole.join(sums, "r").withColumn("kap", F.exp("log_kappa"))
            up, curve = F.col("kap") * F.col("score"), F.col("kap") * F.col("score") + F.col("kap") * F.col("kap") * F.col("bend")
            newton = F.when(curve < 0, clipped(-up / curve, 1.0)).otherwise(F.signum(up) * 0.5)
            bounded = F.greatest(F.least(F.col("log_kappa") + newton, F.lit(LOG_KAPPA[1])), F.lit(LOG_KAPPA[0])) if k == 0 else F.col("log_kappa")
            new = written(near.select("r", bounded.alias("log_kappa"), *[(F.col(s) + slope_step if s == g else F.col(s)).alias(s) for s in slopes], F.greatest(F.abs(bounded - F.col("log_kappa")), F.abs(slope_step)).alias("moved")), "relations")
            third = max(third, new.agg(F.max("moved")).first()[0])
            whole = new.drop("moved")
        most = max(first, second, third)
        settled = most < tolerance
    if not settled:
        warnings.warn(f"effects, slopes or sizes still moved by {most:.2g} after {done} rounds", stacklevel=2)
    const = out.groupBy("r").agg(F.avg("a").alias("const"))
    errors = expected().groupBy("r").agg(F.count(F.lit(1)).alias("n"), *[(1 / F.sqrt(F.sum(F.col("w") * F.col(f"x{k}") * F.col(f"x{k}")))).alias(f"se_{x}") for k, x in enumerate(xs)])
    relations = whole.join(const, "r").join(errors, "r").select(F.col("r").alias(relation), F.exp("log_kappa").alias("kappa"), "const", *[F.col(g).alias(x) for g, x in zip(slopes, xs, strict=True)], *[f"se_{x}" for x in xs], "n")
    senders = out.join(const, "r").select(F.col("r").alias(relation), F.lit("out").alias("kind"), F.col("i").alias("entity_id"), (F.col("a") - F.col("const")).alias("effect"))
    return CountFit(written(relations, "relations"), written(senders.unionByName(into.select(F.col("r").alias(relation), F.lit("in").alias("kind"), F.col("j").alias("entity_id"), F.col("b").alias("effect"))), "effects"), done, settled)


def count_cells(events: DataFrame, period: str = "quarter", day: str = "event_date") -> DataFrame:
    """(relation_id, src, dst, period, n, exposure, history): a cell for each period and pair that exchanged anything at all, zero counts included.

    Exposure is the geometric mean of both ends' numbers of events in the period, history log1p of the count in the period before.
    """
    dated = events.select(F.trunc(day, period).alias("period"), F.col("actor1_entity_id").alias("src_entity_id"), F.col("actor2_entity_id").alias("dst_entity_id"), "relation_id")
    # written: all else is made of it, and the events are read once
    counts = written(dated.groupBy("period", "src_entity_id", "dst_entity_id", "relation_id").agg(F.count(F.lit(1)).alias("n")), "counts")
    ends = counts.withColumn("entity_id", F.explode(F.array_distinct(F.array("src_entity_id", "dst_entity_id")))).groupBy("period", "entity_id").agg(F.sum("n").alias("active"))
    grid = counts.select("src_entity_id", "dst_entity_id").distinct().crossJoin(F.broadcast(counts.select("relation_id").distinct()))  # relations come from one short list
    a = ends.select("period", F.col("entity_id").alias("src_entity_id"), F.col("active").alias("src_active"))
    b = ends.select("period", F.col("entity_id").alias("dst_entity_id"), F.col("active").alias("dst_active"))
    key = ["period", "src_entity_id", "dst_entity_id", "relation_id"]
    cells = grid.join(a, "src_entity_id").join(b, ["period", "dst_entity_id"]).join(counts, key, "left").fillna(0, ["n"])
    before = F.lag("n", 1, 0).over(Window.partitionBy("src_entity_id", "dst_entity_id", "relation_id").orderBy("period"))
    return cells.select(*key, "n", F.sqrt(F.col("src_active") * F.col("dst_active")).alias("exposure"), F.log1p(before).alias("history"))
