"""Hypotheses tested from data: every fit, fold, placebo run and slice out of the same additive moments.

A regression with entity effects needs, of each entity, only its count, sums and sums of products. One
grouped aggregation makes them by hypothesis, run, entity and fold segment; training windows, test
windows, regions and samples without one entity are then sums and differences of a few rows. Centred
moments of an entity and their products are additive too, and hold everything that errors clustered by
entity take, so that no fit reads the data again. Each system is solved inside its row by sweeping.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.config import DEFAULT, Config
from presslens.operators.models import normal_p
from presslens.operators.validation import bh_fdr, composite_score, decide, failure_reason
from presslens.operators.windows import by_day
from presslens.scratch import materialize


def pairs_of(k: int) -> list[tuple[int, int]]:
    """Places of the upper triangle over k regressors and the target, which is number k."""
    return list(combinations_with_replacement(range(k + 1), 2))


def moments(rows: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str = "y") -> DataFrame:
    """By keys: n, sums s0.. and sums of products m0_0.. of the regressors and the target."""
    v = [F.col(c).cast("double") for c in (*xs, y)]
    whole = rows.dropna(subset=[*xs, y])
    return whole.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(v)],
        *[F.sum(v[i] * v[j]).alias(f"m{i}_{j}") for i, j in pairs_of(len(xs))],
    )


def moment_names(k: int) -> list[str]:
    return ["n", *[f"s{i}" for i in range(k + 1)], *[f"m{i}_{j}" for i, j in pairs_of(k)]]


def added(m: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    return m.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in moment_names(k)])


def centred_names(k: int) -> tuple[list[str], list[tuple[str, str, str]]]:
    """Names of centred moments, and (name, first, second) of their products. The target's own square isn't needed by errors."""
    c = [f"c{i}_{j}" for i, j in pairs_of(k)]
    return c, [(f"q_{a}_{b}", a, b) for a, b in combinations_with_replacement(c[:-1], 2)]


def centred(m: DataFrame, k: int) -> DataFrame:
    """Moments of each row's entity around its own means, and their products: all of them additive over entities."""
    names, products = centred_names(k)
    out = m.withColumns({f"c{i}_{j}": F.col(f"m{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") for i, j in pairs_of(k)})
    return out.withColumns({q: F.col(a) * F.col(b) for q, a, b in products}).withColumn("g", F.lit(1.0))


def additive_names(k: int) -> list[str]:
    names, products = centred_names(k)
    return ["n", "g", *names, *[q for q, _, _ in products]]


def pooled(c: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Centred moments added up over entities."""
    return c.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in additive_names(k)])


def solved(sums: DataFrame, k: int, keep: Sequence[str]) -> DataFrame:
    """``keep``, n, g, beta0.., se0.., tss and rss of each row of ``pooled`` sums. Null where regressors are collinear."""
    at = {(i, j): f"c{min(i, j)}_{max(i, j)}" for i in range(k + 1) for j in range(k + 1)}
    df = sums.withColumns({f"a{i}_{j}": F.col(at[i, j]) for i, j in pairs_of(k)})
    a = lambda i, j: F.col(f"a{min(i, j)}_{max(i, j)}")
    for p in range(k):  # sweep regressor p in
        d = F.when(a(p, p) > 1e-10 * F.col(f"c{p}_{p}"), a(p, p))
        new = {}
        for i, j in pairs_of(k):
            if i == p and j == p:
                value = -1 / d
            elif p in (i, j):
                value = a(i, j) / d
            else:
                value = a(i, j) - a(i, p) * a(p, j) / d
            new[f"a{i}_{j}"] = value
        df = df.withColumns(new)
    beta = [a(i, k) for i in range(k)]

    def product(x: str, y: str) -> Column:
        return F.col(f"q_{x}_{y}" if x <= y else f"q_{y}_{x}")

    def scores(i: int) -> list[tuple[Column, str]]:
        """An entity's score of regressor i, as weights of its centred moments."""
        return [(F.lit(1.0), at[i, k]), *[(-beta[j], at[i, j]) for j in range(k)]]

    meat = {(i, j): sum((u * v * product(x, y) for u, x in scores(i) for v, y in scores(j)), F.lit(0.0)) for i in range(k) for j in range(i, k)}
    df = df.withColumns({f"w{i}_{j}": c for (i, j), c in meat.items()})
    w = lambda i, j: F.col(f"w{min(i, j)}_{max(i, j)}")
    var = [sum((a(i, x) * a(i, y) * w(x, y) for x in range(k) for y in range(k)), F.lit(0.0)) for i in range(k)]
    finite = F.when(F.col("g") > 1, F.col("g") / (F.col("g") - 1))
    return df.select(
        *keep, "n", "g", *[beta[i].alias(f"beta{i}") for i in range(k)], *[F.sqrt(F.greatest(var[i], F.lit(0.0)) * finite).alias(f"se{i}") for i in range(k)],
        F.col(f"c{k}_{k}").alias("tss"), a(k, k).alias("rss"),
    )


def tested(fits: DataFrame) -> DataFrame:
    """With t and p of the first regressor; null without spread."""
    out = fits.withColumn("t", F.when(F.col("se0") > 0, F.col("beta0") / F.col("se0")))
    return out.withColumn("p", normal_p(F.col("t")))


def segment(day: str, starts: Sequence[str]) -> Column:
    """How many of the test windows have begun on a day: 0 before the first."""
    return sum((F.when(F.col(day) >= F.lit(s).cast("date"), 1).otherwise(0) for s in starts), F.lit(0))


def feature_panel(daily: DataFrame, targets: DataFrame, features: Sequence[str], values: Sequence[str], windows: Sequence[int], horizons: Sequence[int], lag_days: int = 1, price: str = "px") -> DataFrame:
    """A row for each feature and target day: {value}_{window} as known ``lag_days`` before, y_{h} and the day y_date_{h} when it is known, and ``momentum``.

    ``daily`` (feature_id, entity_id, date, values) needs rows only on days with events; sums are taken at the
    target's days in one sorted pass. A series has a row a day at most.
    """
    ahead = Window.partitionBy("entity_id").orderBy("date")
    y = {}
    for h in horizons:
        y |= {f"y_{h}": F.lead(price, h).over(ahead) / F.col(price) - 1, f"y_date_{h}": F.lead("date", h).over(ahead)}
    known = targets.withColumns(y | {"momentum": F.col(price) / F.lag(price).over(ahead) - 1}).drop(price)
    asked = known.withColumn("feature_id", F.explode(F.array(*map(F.lit, features)))).withColumn("asked", F.lit(True))
    both = daily.select("feature_id", "entity_id", "date", *values).unionByName(asked, True)
    w = by_day(["feature_id", "entity_id"])
    sums = {f"{v}_{n}": F.coalesce(F.sum(v).over(w.rangeBetween(-(n - 1) - lag_days, -lag_days)), F.lit(0.0)) for v in values for n in windows}
    return both.withColumns(sums).filter("asked").drop("asked", *values)


def shuffled(panel: DataFrame, xs: Sequence[str], keys: Sequence[str], within: Sequence[str], runs: Sequence[int], seed: int) -> DataFrame:
    """``panel`` once per run with ``xs`` permuted together among the rows of each group of ``within``, by seeded hashes.

    ``keys`` are a row's identity. For series of days or the entities of a day, groups that the calendar or the universe bounds.
    """
    each = panel.withColumn("run_id", F.explode(F.array(*map(F.lit, runs))))
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("run_id").cast("string"), *[F.col(k).cast("string") for k in keys]))
    groups = Window.partitionBy("run_id", *within)
    given = each.select("run_id", *within, F.row_number().over(groups.orderBy(mixed, *keys)).alias("place"), *xs)
    taken = each.drop(*xs).withColumn("place", F.row_number().over(groups.orderBy(*keys)))
    return taken.join(given, ["run_id", *within, "place"]).drop("place")


def hypothesis_rows(panel: DataFrame, value: str, windows: Sequence[int], horizons: Sequence[int]) -> DataFrame:
    """A row for each hypothesis (feature, window, horizon) and observation: x, momentum, y, date, y_date."""
    specs = [F.struct(F.lit(n).alias("window_days"), F.lit(h).alias("horizon"), F.col(f"{value}_{n}").alias("x"), F.col(f"y_{h}").alias("y"), F.col(f"y_date_{h}").alias("y_date")) for n in windows for h in horizons]
    return panel.withColumn("spec", F.explode(F.array(*specs))).select(*[c for c in ("run_id", "region") if c in panel.columns], "feature_id", "entity_id", "date", "momentum", "spec.*").filter("y is not null and momentum is not null")


SPEC = ["feature_id", "window_days", "horizon"]


def fold_fits(segments: DataFrame, folds: int, k: int, keys: Sequence[str] = SPEC) -> DataFrame:
    """Fits on each purged training window, and how they do on the test window behind it: keys, fold_id, beta0, t, r2_train, r2_oos, sse, sst, cov, var.

    ``segments``: moments by keys, entity_id, known_in and seen_in, the segments of the day y is known and of the day
    itself. Training takes what was known before the test begins, testing what was seen inside it.
    """
    every = segments.withColumn("fold_id", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    names = moment_names(k)
    role = {f"train_{c}": F.sum(F.when(F.col("known_in") < F.col("fold_id"), F.col(c))) for c in names} | {f"test_{c}": F.sum(F.when(F.col("seen_in") == F.col("fold_id"), F.col(c))) for c in names}
    by_entity = every.groupBy(*keys, "fold_id", "entity_id").agg(*[c.alias(n) for n, c in role.items()]).filter("train_n is not null")
    train = by_entity.select(*keys, "fold_id", "entity_id", *[F.col(f"train_{c}").alias(c) for c in names])
    fits = tested(solved(pooled(centred(train, k), [*keys, "fold_id"], k), k, [*keys, "fold_id"]))
    joined = by_entity.filter("test_n is not null").join(fits.select(*keys, "fold_id", *[f"beta{i}" for i in range(k)]), [*keys, "fold_id"])
    mean = lambda i: F.col(f"train_s{i}") / F.col("train_n")
    test_s, test_m = lambda i: F.col(f"test_s{i}"), lambda i, j: F.col(f"test_m{min(i, j)}_{max(i, j)}")
    beta = [F.col(f"beta{i}") for i in range(k)]
    const = mean(k) - sum((beta[i] * mean(i) for i in range(k)), F.lit(0.0))
    fitted = sum((beta[i] * test_s(i) for i in range(k)), F.lit(0.0)) + const * F.col("test_n")  # sum of predictions
    cross = sum((beta[i] * test_m(i, k) for i in range(k)), F.lit(0.0)) + const * test_s(k)  # of predictions and targets
    square = sum((beta[i] * beta[j] * test_m(i, j) for i in range(k) for j in range(k)), F.lit(0.0)) + 2 * const * sum((beta[i] * test_s(i) for i in range(k)), F.lit(0.0)) + const * const * F.col("test_n")
    sse = test_m(k, k) - 2 * cross + square
    sst = test_m(k, k) - 2 * mean(k) * test_s(k) + mean(k) * mean(k) * F.col("test_n")
    tests = joined.select(*keys, "fold_id", F.col("test_n").alias("tn"), sse.alias("sse"), sst.alias("sst"), fitted.alias("f"), test_s(k).alias("o"), cross.alias("fo"), square.alias("ff"))
    sums = tests.groupBy(*keys, "fold_id").agg(*[F.sum(c).alias(c) for c in ("tn", "sse", "sst", "f", "o", "fo", "ff")])
    out = fits.join(sums, [*keys, "fold_id"], "left")
    return out.select(
        *keys, "fold_id", "n", "beta0", "t", F.when(F.col("tss") > 0, 1 - F.col("rss") / F.col("tss")).alias("r2_train"), F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r2_oos"), "sse", "sst",
        (F.col("fo") - F.col("f") * F.col("o") / F.col("tn")).alias("cov"), (F.col("ff") - F.col("f") * F.col("f") / F.col("tn")).alias("var"),
    )


def segmented(rows: DataFrame, starts: Sequence[str], xs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    tagged = rows.withColumn("known_in", segment("y_date", starts)).withColumn("seen_in", segment("date", starts))
    return moments(tagged, [*keys, "entity_id", "known_in", "seen_in"], xs)


def run_hypotheses(
    panel: DataFrame, specs: DataFrame, starts: Sequence[str], value: str, windows: Sequence[int], horizons: Sequence[int], regions: DataFrame, runs: int = 20, seed: int = 7, least_rows: int = 100, cfg: Config = DEFAULT,
) -> DataFrame:
    """A row for each hypothesis: its fit, q in its family, folds, placebo runs, slices, score, verdict and what speaks against it.

    ``specs``: feature_id, window_days, horizon, family, expected_sign. ``starts``: first days of the test windows, in order.
    Half of the placebo runs shuffle dates within an entity, the others entities within a day. Slices are ``regions``
    (entity_id, region): one counts if it has the expected sign at the 10% level. Without rows there is no row.
    Every set of fits is written, as a row each: what reads one has no plan of all the others in it, which the driver would hold.
    """
    xs = ["x", "momentum"]
    k = len(xs)
    columns = [f"{value}_{n}" for n in windows]
    lean = materialize(panel.select("feature_id", "entity_id", "date", "momentum", *columns, *[f"y_{h}" for h in horizons], *[f"y_date_{h}" for h in horizons]), "panel")
    segments = materialize(segmented(hypothesis_rows(lean, value, windows, horizons), starts, xs, SPEC), "segments")
    by_entity = added(segments, [*SPEC, "entity_id"], k)
    own = centred(by_entity, k)
    whole = materialize(tested(solved(pooled(own, SPEC, k), k, SPEC)).withColumn("r2_in_sample", 1 - F.col("rss") / F.col("tss")), "whole")
    sliced = materialize(tested(solved(pooled(own.join(regions, "entity_id"), [*SPEC, "region"], k), k, [*SPEC, "region"])), "slices")
    folds = materialize(fold_fits(segments, len(starts), k), "folds")
    days = shuffled(lean, columns, ["feature_id", "entity_id", "date"], ["feature_id", "entity_id"], range(runs // 2), seed)
    entities = shuffled(lean, columns, ["feature_id", "entity_id", "date"], ["feature_id", "date"], range(runs // 2, runs), seed)
    drawn = moments(hypothesis_rows(days.unionByName(entities), value, windows, horizons), [*SPEC, "run_id", "entity_id"], xs)
    placebo = materialize(tested(solved(pooled(centred(drawn, k), [*SPEC, "run_id"], k), k, [*SPEC, "run_id"])).select(*SPEC, F.col("t").alias("placebo_t")), "placebo")

    fits = materialize(bh_fdr(specs.join(whole, SPEC).withColumn("name", F.concat_ws("/", *SPEC)), "family", "p", "name"), "fits")
    sign = F.signum("beta0")
    held = folds.join(fits.select(*SPEC, sign.alias("sign")), SPEC).groupBy(*SPEC).agg(
        F.count("r2_oos").alias("folds"), F.count_if(F.col("r2_oos") > 0).alias("folds_positive"), F.avg((F.signum("beta0") == F.col("sign")).cast("double")).alias("sign_stability"),
        F.avg("r2_train").alias("r2_train"), (1 - F.sum("sse") / F.sum("sst")).alias("r2_oos"), F.try_divide(F.sum("cov"), F.sum("var")).alias("calibration_slope"),
    )
    passed = sliced.join(specs, SPEC).groupBy(*SPEC).agg(F.count_if((F.signum("beta0") == F.col("expected_sign")) & (F.col("p") < 0.1)).alias("slices_passed"))
    beaten = placebo.join(fits.select(*SPEC, "t"), SPEC).groupBy(*SPEC).agg(((1 + F.count_if(F.abs("placebo_t") >= F.abs("t"))) / (1 + F.count(F.lit(1)))).alias("placebo_p"))
    met = fits.join(held, SPEC, "left").join(passed, SPEC, "left").join(beaten, SPEC, "left").withColumn("sign", sign)
    judged = met.withColumns({
        "data_ok": F.col("n") >= least_rows, "mapping_ok": F.col("g") > 1, "feature_ok": F.col("t").isNotNull(), "cost_ok": F.col("n") <= cfg.max_days * cfg.max_entities * 1.0,
        "predictive_power": F.greatest("r2_oos", F.lit(0.0)), "calibration": F.greatest(1 - F.abs(F.col("calibration_slope") - 1), F.lit(0.0)), "stability": F.col("sign_stability"), "complexity": F.lit(float(k)), "data_cost": F.col("n"),
    })
    scored = composite_score(materialize(judged, "judged")).withColumn("verdict", decide()).withColumn("reason", F.when(F.col("verdict") != "supported", failure_reason()))
    return scored.select(
        *SPEC, "family", "expected_sign", F.col("n").cast("long").alias("n"), F.col("beta0").alias("coef"), F.col("se0").alias("se"), "t", "p", "q", "r2_in_sample", "r2_train", "r2_oos", "calibration_slope",
        "folds", "folds_positive", "sign_stability", "slices_passed", "placebo_p", "score", "verdict", "reason",
    )


def left_out(own: DataFrame, keys: Sequence[str], k: int, kind: str, label: str) -> DataFrame:
    """Fits without one ``label`` (an entity or a region) each: its additive moments taken away from the total."""
    names = additive_names(k)
    total = pooled(own, keys, k).select(*keys, *[F.col(c).alias(f"all_{c}") for c in names])
    parts = pooled(own, [*keys, label], k)
    rest = parts.join(total, list(keys)).select(*keys, F.lit(kind).alias("kind"), F.col(label).cast("string").alias("check_id"), *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in names])
    return solved(rest, k, [*keys, "kind", "check_id"])


def robustness_checks(panel: DataFrame, forms: dict[tuple[str, str], tuple[Column, Column | None]], base: tuple[str, str], horizon: int, regions: DataFrame, starts: Sequence[str], runs: int = 3, seed: int = 7) -> DataFrame:
    """(feature_id, kind, check_id, n, coef, se, t, p, agrees): what becomes of a feature's slope when one choice is changed.

    ``forms``: by (kind, check_id) the regressor and, or not, which rows stay; ``base`` is the one that entities and
    regions are left out of, that training windows roll over, and that placebo runs shuffle.
    """
    xs, key = ["x", "momentum"], ["feature_id", "kind", "check_id"]
    k = len(xs)
    wide = materialize(panel.withColumn("x_base", forms[base][0]), "wide")  # forms and placebo runs both read it
    each = [F.when(F.lit(True) if stay is None else F.coalesce(stay, F.lit(False)), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("check_id"), x.cast("double").alias("x"))) for (kind, name), (x, stay) in forms.items()]
    seen = ["feature_id", "entity_id", "date", "momentum", F.col(f"y_{horizon}").alias("y"), F.col(f"y_date_{horizon}").alias("y_date")]
    long = wide.select(*seen, F.explode(F.array_compact(F.array(*each))).alias("form")).select("feature_id", "entity_id", "date", "momentum", "y", "y_date", "form.*")
    segments = materialize(segmented(long, starts, xs, key), "checks")
    own = centred(added(segments, [*key, "entity_id"], k), k)
    plain = solved(pooled(own, key, k), k, key)
    based = own.filter((F.col("kind") == base[0]) & (F.col("check_id") == base[1])).drop("kind", "check_id")
    entity = left_out(based, ["feature_id"], k, "without_entity", "entity_id")
    region = left_out(based.join(regions, "entity_id"), ["feature_id"], k, "without_region", "region")
    rolled = segments.filter((F.col("kind") == base[0]) & (F.col("check_id") == base[1])).withColumn("fold_id", F.explode(F.sequence(F.lit(1), F.lit(len(starts))))).filter("known_in < fold_id")
    windows = solved(pooled(centred(added(rolled, ["feature_id", "fold_id", "entity_id"], k), k), ["feature_id", "fold_id"], k), k, ["feature_id", F.lit("train_window").alias("kind"), F.col("fold_id").cast("string").alias("check_id")])
    lean = materialize(wide.select(*seen, "x_base"), "placebo")
    groups = {"shuffle_date": ["feature_id", "entity_id"], "shuffle_entity": ["feature_id", "date"], "shuffle_feature": ["entity_id", "date"]}
    drawn = [shuffled(lean, ["x_base"], ["feature_id", "entity_id", "date"], by, range(runs), seed).withColumn("kind", F.lit(kind)) for kind, by in groups.items()]
    mixed = drawn[0].unionByName(drawn[1]).unionByName(drawn[2]).withColumnRenamed("x_base", "x").withColumn("check_id", F.col("run_id").cast("string"))
    placebo = solved(pooled(centred(moments(mixed, [*key, "entity_id"], xs), k), key, k), k, key)
    every = materialize(tested(plain.unionByName(entity).unionByName(region).unionByName(windows).unionByName(placebo)), "fits")
    sign = every.filter((F.col("kind") == base[0]) & (F.col("check_id") == base[1])).select("feature_id", F.signum("beta0").alias("base_sign"))
    return every.join(sign, "feature_id").select("feature_id", "kind", "check_id", F.col("n").cast("long").alias("n"), F.col("beta0").alias("coef"), F.col("se0").alias("se"), "t", "p", (F.signum("beta0") == F.col("base_sign")).alias("agrees"))
