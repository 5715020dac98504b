"""Walk-forward validation, metrics, placebo runs, false-discovery control and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslens.config import ALLOWED_MODELS, DEFAULT, MOVES, SCORE_WEIGHTS, Config
from presslens.operators.ranges import running_before


def folds_of(panel: DataFrame, train_months: int, months: int = 6, day: str = "date") -> DataFrame:
    """Folds over the dates that ``panel`` has: the first test begins ``train_months`` after its first date."""
    ends = panel.agg(F.min(day).alias("lo"), F.max(day).alias("hi"), F.add_months(F.min(day), train_months).alias("test")).first()  # one row
    if ends["lo"] is None:
        return walk_forward_folds(panel.sparkSession, "1970-01-01", "1970-01-01", "1970-01-01", months)
    return walk_forward_folds(panel.sparkSession, str(ends["lo"]), str(ends["test"]), str(ends["hi"]), months)


def walk_forward_folds(spark: SparkSession, start: str, test_start: str, end: str, months: int = 6) -> DataFrame:
    """(fold_id, train_start, train_end, test_start, test_end), ends exclusive: training starts where it starts and grows, tests don't overlap."""
    step = F.expr(f"interval {months} months")
    last = F.lit(end).cast("date")
    starts = F.filter(F.sequence(F.lit(test_start).cast("date"), last, step), lambda d: d < last)
    folds = spark.range(1).select(F.posexplode(starts).alias("fold_id", "test_start"))
    return folds.select("fold_id", F.lit(start).cast("date").alias("train_start"), F.col("test_start").alias("train_end"), "test_start", F.least(F.add_months("test_start", months), last).alias("test_end"))


def assign_folds(panel: DataFrame, folds: DataFrame, day: str = "date") -> DataFrame:
    """Every row in every fold that holds it, as train or test. Folds are a handful."""
    held = (F.col(day) >= folds["train_start"]) & (F.col(day) < folds["test_end"])
    return panel.join(F.broadcast(folds), held).withColumn("role", F.when(F.col(day) < F.col("test_start"), "train").otherwise("test"))


def metrics_reg(pred: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", mean: str = "train_mean") -> DataFrame:
    """r2_oos against the training mean, rmse, mae."""
    e = F.col(y) - F.col(p)
    base = F.sum((F.col(y) - F.col(mean)) * (F.col(y) - F.col(mean)))
    return pred.groupBy(*by).agg(F.when(base > 0, 1 - F.sum(e * e) / base).alias("r2_oos"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def metrics_dir(pred: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Share of right signs, and of right ones where a side was taken."""
    right = (F.signum(p) == F.signum(y)).cast("double")
    return pred.groupBy(*by).agg(F.avg(right).alias("directional_accuracy"), F.avg(F.when(F.col(p) != 0, right)).alias("hit_ratio"))


def average_rank(by: Sequence[str], c: str) -> Column:
    """Rank from 1, ties sharing their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2


def ic(pred: DataFrame, day: str = "date", y: str = "y", p: str = "p") -> DataFrame:
    """Rank correlation of each day."""
    ranked = pred.withColumn("ry", average_rank([day], y)).withColumn("rp", average_rank([day], p))
    return ranked.groupBy(day).agg(F.count("*").alias("n"), F.corr("ry", "rp").alias("ic"))


def metrics_cls(pred: DataFrame, y: str = "y", p: str = "p", clip: float = 1e-9) -> DataFrame:
    """Log loss, and AUC from rank sums. Ranks come from counts by distinct score, added up over ranges of scores."""
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col(p)))
    loss = pred.agg(F.avg(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"))
    counts = pred.groupBy(F.col(p).alias("s")).agg(F.sum(y).cast("double").alias("pos"), F.count("*").cast("double").alias("n"))
    ranked = running_before(counts, ["s"], F.col("n"), "below").withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    total = ranked.agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p1"), F.sum("n").alias("n"))
    auc = total.select(F.when((F.col("p1") > 0) & (F.col("p1") < F.col("n")), (F.col("r") - F.col("p1") * (F.col("p1") + 1) / 2) / (F.col("p1") * (F.col("n") - F.col("p1")))).alias("auc"))
    return loss.join(auc)


def calibration(pred: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """By bucket of probability: rows, mean prediction, mean outcome."""
    bucket = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return pred.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def brier(pred: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return pred.agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"), F.regr_slope(F.col(y), F.col(p)).alias("calibration_slope"))


def placebo(panel: DataFrame, x: str, keys: Sequence[str], runs: int, seed: int, within: Sequence[str] = ()) -> DataFrame:
    """``panel`` once per run with ``x`` permuted (inside each group of ``within``), seeded: run_id, x_placebo.

    At most 20 runs. The marginal distribution of x stays what it was.
    """
    if runs > 20:
        raise ValueError("at most 20 placebo runs")
    each = panel.withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    groups = ["run_id", *within]
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("run_id").cast("string"), key))
    placed = running_before(each, keys, F.lit(1), "n", groups)
    drawn = running_before(each.withColumn("mixed", mixed), ["mixed", *keys], F.lit(1), "n", groups).select(*groups, "n", F.col(x).alias("x_placebo"))
    return placed.join(drawn, [*groups, "n"]).drop("n")


def placebo_p(stats: DataFrame, by: Sequence[str], stat: str, observed: str) -> DataFrame:
    return stats.groupBy(*by).agg(((1 + F.count_if(F.abs(stat) >= F.abs(observed))) / (1 + F.count("*"))).alias("placebo_p"))


def bh_fdr(df: DataFrame, family: str, p: str, tie: str) -> DataFrame:
    """Benjamini-Hochberg q, and the family's size. A family is what one user tests together."""
    w = Window.partitionBy(family)
    ranked = df.withColumn("family_size", F.count(p).over(w)).withColumn("p_rank", F.row_number().over(w.orderBy(F.col(p).asc_nulls_last(), tie)))
    raw = F.col(p) * F.col("family_size") / F.col("p_rank")
    down = w.orderBy(F.desc("p_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(raw).over(down)))).drop("p_rank")


def composite_score(runs: DataFrame, weights: dict[str, float] = SCORE_WEIGHTS) -> DataFrame:
    """Weighted sum of min-max scaled columns; a column without spread counts 0."""
    bounds = runs.agg(*[f(c).alias(f"{n}_{c}") for c in weights for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    score = F.lit(0.0)
    for c, w in weights.items():
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        score = score + w * F.coalesce(F.when(hi > lo, (F.col(c) - lo) / (hi - lo)), F.lit(0.0))
    return runs.join(F.broadcast(bounds)).withColumn("score", score).drop(*bounds.columns)


def failure_reason() -> Column:
    """Why a run failed, the first that holds; null for one that has nothing against it."""
    return (
        F.when(~F.col("mapping_ok"), "bad_entity_mapping").when(~F.col("data_ok"), "data_quality").when(~F.col("feature_ok"), "ambiguous_feature")
        .when(~F.col("cost_ok"), "cost_excessive").when(F.col("q") >= 0.1, "no_signal").when(F.col("sign") != F.col("expected_sign"), "wrong_sign")
        .when(F.col("placebo_p") >= 0.05, "placebo_fail").when((F.col("r2_train") > 0) & (F.col("r2_oos") <= 0), "overfit").when(F.col("sign_stability") < 0.8, "unstable")
    )


def decide() -> Column:
    """supported, rejected or inconclusive, with the default thresholds."""
    ok = (F.col("q") < 0.1) & (F.col("sign") == F.col("expected_sign")) & (F.col("sign_stability") >= 0.8) & (F.col("r2_oos") > 0) & (F.col("placebo_p") < 0.05)
    wrong = ((F.col("q") < 0.1) & (F.col("sign") != F.col("expected_sign"))) | (F.col("folds_positive") == 0)
    return F.when(ok & (F.col("slices_passed") >= 2), "supported").when(wrong, "rejected").otherwise("inconclusive")


def hypothesis_tree(spark: SparkSession, hypotheses: DataFrame) -> DataFrame:
    """(id, root, depth) of every hypothesis; columns id and parent_id."""
    return spark.sql(
        """with recursive tree(id, root, depth) as (
             select id, id, 0 from {h} where parent_id is null
             union all select c.id, t.root, t.depth + 1 from tree t join {h} c on c.parent_id = t.id)
           select id, root, depth from tree""",
        h=hypotheses,
    )


def prior_failures(failed: DataFrame, spec: DataFrame) -> DataFrame:
    """Failed runs with the feature and target of a spec. ``spec_json`` holds both."""
    fields = "feature string, target string"
    known = failed.select("hypothesis_id", "failure_reason", F.from_json("spec_json", fields).alias("s")).select("hypothesis_id", "failure_reason", "s.*")
    asked = spec.select(F.col("hypothesis_id").alias("asked_id"), F.from_json("spec_json", fields).alias("s")).select("asked_id", "s.*")
    return asked.join(known, ["feature", "target"]).filter("asked_id <> hypothesis_id")


def compare(metrics: DataFrame, names: Sequence[str], ids: Sequence[str] | None = None) -> DataFrame:
    """A row per run, all or those of ``ids``, with a column for each metric."""
    chosen = metrics if ids is None else metrics.filter(F.col("run_id").isin(*ids))
    return chosen.groupBy("run_id").pivot("metric", list(names)).agg(F.max("value"))


def check_specs(specs: DataFrame, cfg: Config = DEFAULT, models: Sequence[str] = ALLOWED_MODELS, registry: DataFrame | None = None) -> DataFrame:
    """(spec_id, reasons): what is wrong with each spec; none for a good one. With a ``registry`` (id), its feature_id has to be in there."""
    bad = {
        "negative_lag": F.col("lag") < 0, "no_horizon": F.col("horizon") <= 0, "train_after_test": F.col("train_start") >= F.col("test_start"),
        "too_many_days": F.date_diff("test_end", "train_start") > cfg.max_days, "too_many_entities": F.col("n_entities") > cfg.max_entities, "unknown_model": ~F.col("model").isin(*models),
    }
    if registry is not None:  # ids of features, targets and datasets, one row each
        known = registry.select(F.col("id").alias("registered")).distinct()
        specs = specs.join(known, F.col("feature_id") == F.col("registered"), "left")
        bad["unregistered_id"] = F.col("registered").isNull()
    return specs.select("spec_id", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in bad.items()])).alias("reasons"))


def estimate_cost(stats: DataFrame, start: str, end: str, entities: int, day: str = "date") -> DataFrame:
    """Rows, dates and partitions a run would touch, from the table of partition statistics alone."""
    inside = stats.filter(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return inside.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_distinct(day).alias("dates"), F.count("*").alias("partitions"), (F.count_distinct(day) * entities).alias("panel_rows"))


def illegal_transitions(log: DataFrame, moves: Sequence[tuple[str, str]] = MOVES) -> DataFrame:
    """Status changes outside the allowed ones."""
    w = Window.partitionBy("hypothesis_id").orderBy("seq")
    steps = log.withColumn("before", F.lag("status").over(w)).filter("before is not null and before <> status")
    allowed = F.broadcast(log.sparkSession.createDataFrame(list(moves), "before string, status string"))
    return steps.join(allowed, ["before", "status"], "left_anti")


def run_report(runs: DataFrame, metrics: Sequence[str], key: str = "run_id") -> DataFrame:
    return runs.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(key, list(metrics), "metric", "value")
