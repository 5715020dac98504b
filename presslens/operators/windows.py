"""Windows over daily series. Frames that score a day end before it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from presslens.config import DEFAULT, Config
from presslens.functions.weights import tau
from presslens.operators.ranges import greatest_before, running_before


def by_day(keys: Sequence[str], day: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.unix_date(day))


def in_blocks(df: DataFrame, day: str, back: int, width: int | None = None) -> DataFrame:
    """``df`` with w_block, and each row again in the later blocks of days whose frames reach back to it; w_own marks a row in its own block.

    Windows by (keys, w_block) then see all that frames of ``back`` days need, and a long series is as many tasks as it
    has blocks. The wider a block, the fewer rows are copied.
    """
    width = width or back + 1
    at = F.unix_date(day)
    first = F.floor(at / width)
    return df.withColumn("w_block", F.explode(F.sequence(first, F.floor((at + back) / width)))).withColumn("w_own", F.col("w_block") == first)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("w_own").drop("w_block", "w_own")


def rolling_sum(df: DataFrame, keys: Sequence[str], value: str, days: int, out: str, day: str = "date") -> DataFrame:
    """Over the last ``days`` days, this one included. Days without a row need none."""
    blocks = in_blocks(df, day, days - 1, max(366, 4 * days))
    return own_rows(blocks.withColumn(out, F.sum(value).over(by_day([*keys, "w_block"], day).rangeBetween(-(days - 1), 0))))


def decay_sum(df: DataFrame, keys: Sequence[str], value: str, out: str, half_life: float = DEFAULT.half_life_days, day: str = "date") -> DataFrame:
    """Sum of earlier values, each halved every ``half_life`` days.

    In closed form as a running sum of values scaled by exp(age / tau). To stay within a double's
    range the scale starts anew every 500 tau; what earlier blocks leave is carried over once per block.
    """
    t = tau(half_life)
    width = max(1, math.floor(500 * t))
    block = F.floor(F.unix_date(day) / width)
    inside = Window.partitionBy(*keys, "d_block")
    scaled = df.withColumn("d_block", block).withColumn("d_age", F.unix_date(day) - F.col("d_block") * width)
    run = scaled.withColumn("d_run", F.sum(F.col(value) * F.exp((F.col("d_age") - width) / t)).over(inside.orderBy("d_age").rangeBetween(Window.unboundedPreceding, 0)))
    ends = run.groupBy(*keys, "d_block").agg(F.max("d_run").alias("d_end"))
    carried = ends.withColumn("d_carry", F.coalesce(F.lag("d_end").over(Window.partitionBy(*keys).orderBy("d_block")) * F.exp((F.lag("d_block").over(Window.partitionBy(*keys).orderBy("d_block")) - F.col("d_block") + 1) * F.lit(width / t)), F.lit(0.0)))
    joined = run.join(carried.drop("d_end"), [*keys, "d_block"])
    return joined.withColumn(out, F.col("d_run") * F.exp((F.lit(width) - F.col("d_age")) / t) + F.col("d_carry") * F.exp(-F.col("d_age") / t)).drop("d_block", "d_age", "d_run", "d_carry")


def scored_in_blocks(blocks: DataFrame, keys: Sequence[str], scores: dict[str, str], cfg: Config = DEFAULT, day: str = "date", min_periods: int | None = None) -> DataFrame:
    """``blocks`` (of ``in_blocks``) with the seasonal score of each value of ``scores`` (name: value), all in one sorted pass.

    Count, sum and sum of squares of a frame are the running ones up to its end less those before its start, so a day costs the
    same whatever the frame's length, around the block's mean. Such a difference has no spread as small as a rounding error of
    the sums; a frame whose values are all equal (to 1e-12 of themselves) is known by its number of changes, and has none.
    """
    w = Window.partitionBy(*keys, "w_block").orderBy(F.unix_date(day))
    x = {out: F.col(value).cast("double") for out, value in scores.items()}
    each = lambda name, made: {f"w_{name}_{out}": made(out) for out in scores}
    mean_of = lambda out: F.avg(x[out]).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    same = lambda out: F.abs(F.lead(x[out]).over(w) - x[out]) <= 1e-12 * F.abs(x[out])
    df = blocks.withColumns(each("mean", mean_of) | each("turn", lambda out: F.when(same(out), 0.0).otherwise(1.0)))
    df = df.withColumns(each("x", lambda out: x[out] - F.col(f"w_mean_{out}")))

    def upto(c: Column, last: int) -> Column:
        return F.coalesce(F.sum(c).over(w.rangeBetween(Window.unboundedPreceding, -last)), F.lit(0.0))

    def inside(c: Column) -> Column:
        return upto(c, cfg.gap_days) - upto(c, cfg.lookback_days + 1)

    turn = lambda out: inside(F.col(f"w_turn_{out}")) - F.last(f"w_turn_{out}").over(w.rangeBetween(Window.unboundedPreceding, -cfg.gap_days))
    df = df.withColumns(
        each("n", lambda out: inside(F.col(f"w_x_{out}").isNotNull().cast("double"))) | each("s", lambda out: inside(F.col(f"w_x_{out}")))
        | each("ss", lambda out: inside(F.col(f"w_x_{out}") * F.col(f"w_x_{out}"))) | each("turns", turn)
    )
    least = cfg.min_periods if min_periods is None else min_periods

    def z(out: str) -> Column:
        n, mean = F.col(f"w_n_{out}"), F.col(f"w_s_{out}") / F.col(f"w_n_{out}")
        spread = F.when(F.col(f"w_turns_{out}") == 0, 0.0).otherwise(F.greatest((F.col(f"w_ss_{out}") - n * mean * mean) / (n - 1), F.lit(0.0)))
        return F.when((n >= least) & (n > 0), (F.col(f"w_x_{out}") - mean) / (F.when(n > 1, F.sqrt(spread)) + cfg.epsilon))

    return df.withColumns({out: z(out) for out in scores}).drop(*[f"w_{name}_{out}" for name in ("mean", "turn", "x", "n", "s", "ss", "turns") for out in scores])


def seasonal_z(df: DataFrame, keys: Sequence[str], value: str, out: str = "zscore", by: str | None = None, cfg: Config = DEFAULT, day: str = "date", min_periods: int | None = None) -> DataFrame:
    """(value - mean) / (sd + epsilon) over days t-365 to t-8; null with fewer than ``min_periods`` of them.

    ``by``: None, 'weekday' or 'month' compares like days only. Sums run inside blocks of days.
    """
    extra = {None: {}, "weekday": {"w_like": F.weekday(day)}, "month": {"w_like": F.month(day)}}[by]
    blocks = in_blocks(df.withColumns(extra) if extra else df, day, cfg.lookback_days)
    return own_rows(scored_in_blocks(blocks, [*keys, *extra], {out: value}, cfg, day, min_periods)).drop(*extra)


def winsorize(df: DataFrame, keys: Sequence[str], value: str, out: str, fit_end: str, low: float = 0.01, high: float = 0.99, day: str = "date") -> DataFrame:
    """Clip to quantiles that only days before ``fit_end`` set."""
    bounds = df.filter(F.col(day) < F.lit(fit_end).cast("date")).groupBy(*keys).agg(F.percentile(value, low).alias("w_low"), F.percentile(value, high).alias("w_high"))
    return df.join(bounds, list(keys), "left").withColumn(out, F.greatest(F.least(F.col(value), F.col("w_high")), F.col("w_low"))).drop("w_low", "w_high")


def lag_matrix(df: DataFrame, keys: Sequence[str], value: str, lags: int, day: str = "date") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(day)
    return df.withColumns({f"{value}_lag{i}": F.lag(value, i).over(w) for i in range(1, lags + 1)})


def forward_return(df: DataFrame, keys: Sequence[str], price: str, horizon: int, out: str, day: str = "date") -> DataFrame:
    return df.withColumn(out, F.lead(price, horizon).over(Window.partitionBy(*keys).orderBy(day)) / F.col(price) - 1)


def topk_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """``order`` has to be total; Spark keeps k rows per task before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def rolling_beta(df: DataFrame, keys: Sequence[str], x: str, y: str, rows: int, out: str = "beta", day: str = "date") -> DataFrame:
    """Slope of y on x over the last ``rows`` rows; null without variance."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-(rows - 1), 0)
    var = F.var_samp(x).over(w)
    return df.withColumn(out, F.when(var > 0, F.covar_samp(x, y).over(w) / var))


def rolling_stability(betas: DataFrame, keys: Sequence[str], beta: str = "beta") -> DataFrame:
    """Share of windows whose slope has the sign of their mean; null without any slope."""
    sign = F.signum(beta)
    whole = betas.groupBy(*keys).agg(F.signum(F.avg(beta)).alias("s"), F.count(beta).alias("n"), *[F.count_if(sign == s).alias(name) for name, s in (("below", -1), ("zero", 0), ("above", 1))])
    agreed = F.when(F.col("s") < 0, F.col("below")).when(F.col("s") > 0, F.col("above")).otherwise(F.col("zero"))
    return whole.select(*keys, F.try_divide(agreed, F.col("n")).alias("sign_stability"))


def exp_smooth(df: DataFrame, keys: Sequence[str], value: str, a: float, day: str = "date") -> DataFrame:
    """The last smoothed value of each series: s = a y + (1 - a) s before it, from the first value on.

    A series has a row per day, so its array is bounded by the calendar.
    """
    series = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(day, F.col(value).cast("double").alias("y")))).alias("ys"))
    first = F.get("ys", F.lit(0))["y"]
    rest = F.slice("ys", 2, F.size("ys"))
    return series.select(*keys, F.aggregate(rest, first, lambda s, p: a * p["y"] + (1 - a) * s).alias("smoothed"))


def leaderboard(runs: DataFrame, score: str) -> DataFrame:
    """``rank`` (dense, best first) and ``percent_rank`` of each run overall; equal scores share both, null scores come last.

    Distinct scores are ranked by ranges, each with the number of its runs.
    """
    places = runs.groupBy(F.col(score).alias("placed_score")).agg(F.count("*").alias("n")).select("placed_score", "n", F.col("placed_score").isNull().alias("unscored"), (-F.col("placed_score")).alias("down"))
    placed = running_before(running_before(places, ["unscored", "down"], F.lit(1), "better_scores"), ["unscored", "down"], F.col("n"), "better_runs")
    ranks = placed.select("placed_score", (F.col("better_scores") + 1).cast("int").alias("rank"), "better_runs")
    total = places.agg(F.sum("n").alias("all_runs"))  # one row
    share = F.coalesce(F.try_divide("better_runs", F.col("all_runs") - 1), F.lit(0.0))
    joined = runs.join(ranks, F.col(score).eqNullSafe(F.col("placed_score"))).join(F.broadcast(total))
    return joined.withColumn("percent_rank", share).drop("placed_score", "better_runs", "all_runs")


def regime_shift(df: DataFrame, keys: Sequence[str], value: str, n: int, threshold: float, day: str = "date") -> DataFrame:
    """Days whose last n values differ from the n before by more than ``threshold`` pooled deviations."""
    w = Window.partitionBy(*keys).orderBy(day)
    now, then = w.rowsBetween(-(n - 1), 0), w.rowsBetween(-(2 * n - 1), -n)
    full = F.count(value).over(then) == n
    pooled = F.sqrt((F.var_samp(value).over(now) + F.var_samp(value).over(then)) / 2)
    moved = F.avg(value).over(now) - F.avg(value).over(then)
    return df.withColumn("shift", F.when(full & (pooled > 0), moved / pooled)).withColumn("regime_shift", F.coalesce(F.abs("shift") > threshold, F.lit(False)))


def narrative_gaps(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int, tie: str) -> DataFrame:
    """First appearance, seconds since the one before, and a running number of sessions split by long gaps.

    What came before is the latest of all that did, so it is found by ranges of (``ts``, ``tie``), which has
    to be a total order: one key uses many tasks. Rows without a time come first, have no gap and leave the
    next one without.
    """
    before = greatest_before(df, [ts, tie], F.col(ts), "ts_before", keys)
    gaps = before.withColumn("gap", F.unix_timestamp(ts) - F.unix_timestamp("ts_before")).drop("ts_before")
    split = F.when(F.col("gap") > gap_seconds, 1).otherwise(0)
    counted = running_before(gaps, [ts, tie], split, "session", keys).withColumn("session", F.col("session") + split)
    first = df.groupBy(*[F.col(k).alias(f"first_{k}") for k in keys]).agg(F.min(ts).alias("first_seen"))
    same = [F.col(k).eqNullSafe(F.col(f"first_{k}")) for k in keys]
    return counted.join(first, same).drop(*[f"first_{k}" for k in keys])
