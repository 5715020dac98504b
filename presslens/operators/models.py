"""Panel models. Rows meet in sums on the executors; the driver solves systems as wide as the number of regressors."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.scratch import materialize as written


def normal_p(t: Column) -> Column:
    """Two-sided p of a normal statistic, by a rational approximation of erfc (error under 1.2e-7)."""
    x = F.abs(t) / math.sqrt(2)
    u = 1 / (1 + 0.5 * x)
    # Coefficients of the approximation, constant first.
    poly = F.lit(0.0)
    for c in reversed([-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]):
        poly = poly * u + c
    return u * F.exp(-x * x + poly)


@dataclass(frozen=True)
class Fit:
    names: tuple[str, ...]
    coef: tuple[float, ...]
    se: tuple[float, ...]
    n: int

    def table(self, df: DataFrame) -> DataFrame:
        """(term, coef, se, t, p, ci_low, ci_high, sign): a row per regressor."""
        rows = [(name, c, s) for name, c, s in zip(self.names, self.coef, self.se, strict=True)]
        out = df.sparkSession.createDataFrame(rows, "term string, coef double, se double").withColumn("t", F.col("coef") / F.col("se"))
        return out.withColumns({"p": normal_p(F.col("t")), "ci_low": F.col("coef") - 1.959964 * F.col("se"), "ci_high": F.col("coef") + 1.959964 * F.col("se"), "sign": F.signum("coef")})


def demean(panel: DataFrame, columns: Sequence[str], groups: Sequence[str], tolerance: float = 1e-8, most: int = 50) -> DataFrame:
    """Columns without the means of each group, in turn until they stop moving; one pass settles a single group or a balanced panel.

    Means are aggregated and joined, so that a large group needs no task of its own. Rows without a group
    take no part.
    """
    df, names = panel, panel.columns
    for _ in range(most):
        for g in groups:
            means = df.groupBy(F.col(g).alias("mean_of")).agg(*[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(columns)])
            joined = df.join(means, F.col(g) == F.col("mean_of"))
            df = joined.withColumns({c: F.col(c) - F.col(f"mean_{i}") for i, c in enumerate(columns)}).select(*names)
        if len(groups) == 1:
            return df
        df = written(df, "demeaned")
        means = df.groupBy(groups[0]).agg(*[F.abs(F.avg(c)).alias(c) for c in columns]).agg(*[F.max(c).alias(c) for c in columns]).first()
        if max([0.0, *(v for v in means if v is not None)]) < tolerance:
            break
    else:
        warnings.warn(f"means of {groups[0]} were still over {tolerance} after {most} passes", stacklevel=2)
    return df


def panel_ols(panel: DataFrame, y: str, xs: Sequence[str], effects: Sequence[str] = ("entity_id", "date"), cluster: str = "entity_id") -> Fit:
    """Least squares with fixed effects and errors clustered by ``cluster``."""
    used = panel.select(y, *xs, *dict.fromkeys([*effects, cluster])).dropna()
    df = demean(used, [y, *xs], list(effects))
    k = len(xs)
    sums = df.agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"m{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate([*xs, y]) if j >= i]).first()
    xx, xy = np.zeros((k, k)), np.array([sums[f"m{i}_{k}"] for i in range(k)], float)
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = sums[f"m{i}_{j}"]
    beta = np.linalg.solve(xx, xy)
    e = F.col(y) - sum((float(b) * F.col(x) for b, x in zip(beta, xs, strict=True)), F.lit(0.0))
    scores = df.groupBy(cluster).agg(*[F.sum(F.col(x) * e).alias(f"s{i}") for i, x in enumerate(xs)])
    meat_row = scores.agg(F.count("*").alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
    meat = np.array([[meat_row[f"m{i}_{j}"] for j in range(k)] for i in range(k)])
    bread, g = np.linalg.inv(xx), meat_row["g"]
    var = bread @ meat @ bread * (g / max(g - 1, 1))
    return Fit(tuple(xs), tuple(map(float, beta)), tuple(float(math.sqrt(max(v, 0))) for v in np.diag(var)), sums["n"])


def event_propagation(pairs: DataFrame, relations: Sequence[str], lags: int, value: str = "weighted_score") -> tuple[DataFrame, list[str]]:
    """A panel of pair and day with every relation's value and its lags 1..L by day, and the regressors' names."""
    wide = pairs.groupBy("date", "src_entity_id", "dst_entity_id").pivot("relation_id", list(relations)).agg(F.sum(value)).fillna(0.0, list(relations))
    keyed = wide.withColumn("pair", F.concat_ws(">", "src_entity_id", "dst_entity_id"))
    names = []
    w = Window.partitionBy("pair").orderBy(F.unix_date("date"))
    for r in relations:
        for lag in range(1, lags + 1):
            name = f"{r}_lag{lag}"
            names.append(name)
            keyed = keyed.withColumn(name, F.coalesce(F.sum(r).over(w.rangeBetween(-lag, -lag)), F.lit(0.0)))
    return keyed, names


def assembled(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(xs), outputCol="features", handleInvalid="skip").transform(df)


def logit(panel: DataFrame, y: str, xs: Sequence[str], regularization: float = 0.0):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(labelCol=y, featuresCol="features", regParam=regularization).fit(assembled(panel, xs))


def poisson(panel: DataFrame, y: str, xs: Sequence[str], exposure: str):
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = assembled(panel.filter(F.col(exposure) > 0).withColumn("log_exposure", F.log(exposure)), xs)
    return GeneralizedLinearRegression(family="poisson", link="log", labelCol=y, featuresCol="features", offsetCol="log_exposure").fit(rows)


def negbin(panel: DataFrame, y: str, xs: Sequence[str], exposure: str, kappa: float, rounds: int = 25, tolerance: float = 1e-8) -> Fit:
    """Negative binomial with log link, offset and given size, by reweighted least squares: one aggregation a step.

    The rows are written first, so that no step makes the panel anew.
    """
    df = written(panel.filter(F.col(exposure) > 0).select(y, *xs, exposure).dropna(), "negbin")
    terms = [F.lit(1.0), *[F.col(x) for x in xs]]
    k = len(terms)
    start = df.agg(F.log(F.greatest(F.avg(y), F.lit(1e-6)) / F.avg(exposure)).alias("b")).first()["b"]
    beta = np.array([start or 0.0, *[0.0] * len(xs)])
    for _ in range(rounds):
        eta = sum((float(b) * t for b, t in zip(beta, terms, strict=True)), F.lit(0.0))
        mu = F.exp(eta) * F.col(exposure)
        w = mu / (1 + mu / kappa)
        z = eta + (F.col(y) - mu) / mu
        row = df.agg(F.count("*").alias("n"), *[F.sum(w * terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(w * terms[i] * z).alias(f"b{i}") for i in range(k)]).first()
        a = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                a[i, j] = a[j, i] = row[f"a{i}_{j}"]
        new = np.linalg.solve(a, np.array([row[f"b{i}"] for i in range(k)]))
        done, beta = float(np.max(np.abs(new - beta))) < tolerance, new
        if done:
            break
    return Fit(("const", *xs), tuple(map(float, beta)), tuple(float(math.sqrt(v)) for v in np.diag(np.linalg.inv(a))), row["n"])


def kalman_level(df: DataFrame, keys: Sequence[str], value: str, q: float, r: float, day: str = "date") -> DataFrame:
    """The filtered level and its variance after the last day of each series (a row a day): a fold over the ordered array."""
    series = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(day, F.col(value).cast("double").alias("y")))).alias("ys"))
    start = F.struct(F.get("ys", F.lit(0))["y"].alias("m"), F.lit(float(r)).alias("p"))

    def step(s: Column, o: Column) -> Column:
        gain = (s["p"] + q) / (s["p"] + q + r)
        return F.struct((s["m"] + gain * (o["y"] - s["m"])).alias("m"), ((1 - gain) * (s["p"] + q)).alias("p"))

    return series.select(*keys, F.aggregate(F.slice("ys", 2, F.size("ys")), start, step).alias("s")).select(*keys, F.col("s.m").alias("level"), F.col("s.p").alias("variance"))


def principal_components(vectors: DataFrame, k: int, column: str = "features"):
    from pyspark.ml.feature import PCA

    return PCA(k=k, inputCol=column, outputCol="pca").fit(vectors)


def rolling_anomaly(scored: DataFrame, threshold: float, z: str = "zscore") -> DataFrame:
    return scored.withColumn("anomaly", F.coalesce(F.abs(z) >= threshold, F.lit(False)))


def score(panel: DataFrame, coefficients: dict[str, float], const: float = 0.0, out: str = "p") -> DataFrame:
    return panel.withColumn(out, sum((b * F.col(x) for x, b in coefficients.items()), F.lit(const)))


def baseline(panel: DataFrame, keys: Sequence[str], value: str, day: str = "date") -> DataFrame:
    """Mean of all earlier values, and the last one."""
    w = Window.partitionBy(*keys).orderBy(day)
    return panel.withColumns({"historic_mean": F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), "last_value": F.lag(value).over(w)})
