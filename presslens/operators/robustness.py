"""Many checks as one grouped job: windows, slices, and parameters as keys of the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.config import DEFAULT, TENSION_WEIGHTS, Config
from presslens.functions.dual import Dual
from presslens.operators.windows import rolling_sum


def robustness_grid(events: DataFrame, targets: DataFrame, slices: dict[str, Column], windows: Sequence[int], value: str = "v", price: str = "px") -> DataFrame:
    """(check_id, n, slope): slope of the target on the rolled value, for each slice and window.

    Events are tagged with the slices that they are in, so one scan and one shuffle serve every check.
    """
    tags = F.array_compact(F.array(*[F.when(inside, F.lit(name)) for name, inside in slices.items()]))
    day = events.withColumn("slice", F.explode(tags)).groupBy("slice", F.col("actor1_entity_id").alias("entity_id"), F.col("event_date").alias("date")).agg(F.sum(value).alias("x0"))
    for n in windows:
        day = rolling_sum(day, ["slice", "entity_id"], "x0", n, f"w{n}")
    long = day.select("slice", "entity_id", "date", *[f"w{n}" for n in windows]).unpivot(["slice", "entity_id", "date"], [f"w{n}" for n in windows], "window", "x")
    named = long.withColumn("check_id", F.concat("slice", F.lit("/"), F.substring("window", 2, 9)))
    return named.join(targets, ["entity_id", "date"]).groupBy("check_id").agg(F.count("*").alias("n"), F.regr_slope(price, "x").alias("slope"))


def sensitivity(events: DataFrame, by: str, mentions: str, grid: Sequence[float]) -> DataFrame:
    """(entity_id, slope): finite difference of the damped mentions' sum over the ends of a parameter grid, in one pass."""
    low, high = min(grid), max(grid)
    damped = lambda a: F.sum(F.pow(F.log1p(F.col(mentions)), F.lit(float(a))))
    return events.groupBy(F.col(by).alias("entity_id")).agg(((damped(high) - damped(low)) / (high - low)).alias("slope"))


GRADIENT = ("mentions_power", "sources_power", "goldstein_weight", "tone_weight", "tone_scale", "half_life_days")


def dual_weight(cfg: Config = DEFAULT) -> Dual:
    """``event_weight`` with what each of its parameters does to it."""
    p = {name: Dual.parameter(name, getattr(cfg, name)) for name in GRADIENT}
    known = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    tone = 1 + p["tone_weight"] * (Dual.constant(-known("avg_tone")) / p["tone_scale"]).tanh()
    strength = 1 + p["goldstein_weight"] * Dual.constant(F.abs(known("goldstein")) / 10)
    return p["mentions_power"].of_base(F.log1p(known("num_mentions"))) * p["sources_power"].of_base(1 + known("num_sources")) * strength * tone


def index_gradient(events: DataFrame, by: str, as_of: str, relations: dict[str, float] = TENSION_WEIGHTS, cfg: Config = DEFAULT, day: str = "event_date") -> DataFrame:
    """(entity_id, index, d_<parameter> ..., d_<relation> ...): an index on a day, decayed, and its gradient.

    Events up to ``as_of`` count, each with its weight, its relation's sign and weight, and what decay has
    left of it. Every derivative is a sum over events, carried beside the value through one aggregation
    with partial sums. The index is linear in the weights of relations, so those derivatives are the
    relations' own levels. Events without a day or of other relations don't count; entities without
    any event that counts have no row.
    """
    age = F.datediff(F.lit(as_of).cast("date"), day).cast("double")
    decay = (Dual.constant(-age * F.log(F.lit(2.0))) / Dual.parameter("half_life_days", cfg.half_life_days)).exp()
    level = dual_weight(cfg) * decay
    signed = F.element_at(F.create_map(*[F.lit(x) for pair in relations.items() for x in (pair[0], float(pair[1]))]), F.col("relation_id"))
    counted = events.filter(F.col("relation_id").isin(*relations) & (age >= 0)).withColumn("sign", signed)
    sums = [F.sum(F.col("sign") * level.value).alias("index")] + [F.sum(F.col("sign") * level.slopes[name]).alias(f"d_{name}") for name in GRADIENT]
    sums += [F.sum(F.when(F.col("relation_id") == name, level.value).otherwise(0.0)).alias(f"d_{name}") for name in relations]
    return counted.groupBy(F.col(by).alias("entity_id")).agg(*sums)
