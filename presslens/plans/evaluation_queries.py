"""Queries for models, validation, data quality, the read API and streams, with DuckDB twins where SQL has them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from presslens.config import TENSION_WEIGHTS
from presslens.functions.weights import event_weight
from presslens.operators import api, counts, factors, gold, indices, models, quality, scans, silver, validation, windows
from presslens.plans.catalog import query
from presslens.plans.scores_queries import STATES, pairs_of, states_of
from presslens.plans.tables_queries import BOTH, DENSE, EV, PAIRS, daily_dense, events, r, rounded
from presslens.scratch import own_dir
from presslens.sources.fixtures import table, view
from presslens.streaming import streams

WEIGHTS = {"cooperation": -1.0, "material_conflict": 1.0, "protest_pressure": 0.5}


def scored(s, d):
    return view(s, d, "scored_label").select("doc_id", F.col("y").cast("double").alias("y"), "p")


# --- models
@query("m1_index_model", f"""with {STATES}, p as (select date, entity_id, state_name, v * case state_name when 'cooperation' then -1.0 when 'material_conflict' then 1.0 else 0.5 end as part from states where state_name in ('cooperation', 'material_conflict', 'protest_pressure'))
 select date, entity_id, state_name, round(part, 4) as part, round(sum(part) over (partition by date, entity_id), 4) as score, round(case when sum(abs(part)) over (partition by date, entity_id) > 0 then abs(part) / sum(abs(part)) over (partition by date, entity_id) end, 4) as share from p""")
def m1(s, d):
    return rounded(indices.index_model(states_of(s, d), WEIGHTS, "weighted_score"), "part", "score", "share")


def panel(s, d):
    said = view(s, d, "world_event").groupBy(F.col("event_date").alias("date"), F.col("actor1_entity_id").alias("entity_id")).agg(F.sum("num_mentions").cast("double").alias("x"), F.count("*").cast("double").alias("n"))
    return view(s, d, "target_daily").join(said, ["date", "entity_id"], "left").fillna(0.0, ["x", "n"])


PANEL = """said as (select event_date as date, actor1_entity_id as entity_id, sum(num_mentions)::double as x, count(*)::double as n from world_event group by 1, 2),
 panel as (select t.date, t.entity_id, t.px, coalesce(s.x, 0) as x, coalesce(s.n, 0) as n from target_daily t left join said s on t.date = s.date and t.entity_id = s.entity_id)"""


@query("m2_panel_ols_one_effect", f"""with {PANEL}, m as (select entity_id, px - avg(px) over (partition by entity_id) as y, x - avg(x) over (partition by entity_id) as x from panel), b as (select regr_slope(y, x) as b from m),
 sc as (select entity_id, sum(x * (y - b * x)) as s from m, b group by 1) select 'x' as term, round(any_value(b), 3) as coef, round(sqrt(sum(s * s) * count(*)::double / (count(*) - 1)) / (select sum(x * x) from m), 3) as se from sc, b""")
def m2(s, d):
    fit = models.panel_ols(panel(s, d), "px", ["x"], ["entity_id"])
    return rounded(fit.table(table(s, d, "region")).select("term", "coef", "se"), "coef", "se", n=3)


@query("m2_panel_ols_two_effects")
def m2b(s, d):
    df = panel(s, d).withColumn("month", F.trunc("date", "month"))
    return rounded(models.panel_ols(df, "px", ["x", "n"], ["entity_id", "month"]).table(df), "coef", "se", "t", "p", n=3)


@query("m3_event_propagation")
def m3(s, d):
    wide, names = models.event_propagation(pairs_of(s, d), ["verbal_conflict", "material_conflict"], 2)
    return rounded(models.panel_ols(wide, "material_conflict", names, ["pair"], "pair").table(wide), "coef", "se", "t", "p")


@query("m4_logit")
def m4(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents"), "doc_id").withColumn("x", F.log1p("n_chars"))
    fit = models.logit(rows, "quality", ["x"])
    return s.createDataFrame([("const", float(fit.intercept)), ("x", float(fit.coefficients[0]))], "term string, coef double").withColumn("coef", F.round("coef", 4))


@query("m5_poisson")
def m5(s, d):
    fit = models.poisson(exposed(s, d), "n", ["tone"], "exposure")
    return s.createDataFrame([("const", float(fit.intercept)), ("tone", float(fit.coefficients[0]))], "term string, coef double").withColumn("coef", F.round("coef", 4))


def exposed(s, d):
    return view(s, d, "world_event").groupBy("event_date", "actor1_entity_id").agg(F.count("*").cast("double").alias("n"), F.avg("avg_tone").alias("tone"), F.sum("num_sources").cast("double").alias("exposure"))


@query("m6_negbin")
def m6(s, d):
    df = exposed(s, d)
    return rounded(models.negbin(df, "n", ["tone"], "exposure", kappa=5.0).table(df), "coef", "se", "t", "p")


@query("m6_negbin_effects")
def m6_effects(s, d):
    """Size, slope on the count before, and sender and receiver effects of every relation, from quarterly cells with zeros."""
    fit = counts.negbin_effects(counts.count_cells(events(s, d)), "n", "exposure", xs=["history"], tolerance=1e-3)
    whole = fit.relations.select("relation_id", F.lit("relation").alias("kind"), F.lit(None).cast("string").alias("entity_id"), F.col("const").alias("effect"), "kappa", F.col("history").alias("slope"), F.col("n").alias("cells"))
    return rounded(whole.unionByName(fit.effects, True), "effect", "kappa", "slope", n=3)


@query("m7_rolling_anomaly", f"with {DENSE}, z as (select date, entity_id, case when count(v) over w >= 90 then (v - avg(v) over w) / (stddev_samp(v) over w + 1e-6) end as z from dense window w as (partition by entity_id order by date range between interval 365 days preceding and interval 8 days preceding)) select date, entity_id, round(z, 3) as zscore from z where abs(z) >= 3")
def m7(s, d):
    z = windows.seasonal_z(daily_dense(s, d), ["entity_id"], "v")
    return models.rolling_anomaly(z, 3.0).filter("anomaly").select("date", "entity_id", r("zscore", 3).alias("zscore"))


@query("m8_kalman_level")
def m8(s, d):
    return rounded(models.kalman_level(view(s, d, "target_daily"), ["entity_id"], "px", 1.0, 10.0), "level", "variance", n=3)


@query("m8_kalman_series", """with recursive o as (select entity_id, date, px, row_number() over (partition by entity_id order by date) as n, count(*) over (partition by entity_id) as total from target_daily),
 f as (select entity_id, date, n, total, px as m, 10.0::double as p from o where n = 1 union all
  select o.entity_id, o.date, o.n, o.total, f.m + (f.p + 1) / (f.p + 1 + 10) * (o.px - f.m), (1 - (f.p + 1) / (f.p + 1 + 10)) * (f.p + 1) from f join o on o.entity_id = f.entity_id and o.n = f.n + 1),
 b as (select entity_id, n, m as sm, p as sp from f where n = total union all
  select f.entity_id, f.n, f.m + f.p / (f.p + 1) * (b.sm - f.m), f.p + (f.p / (f.p + 1)) ** 2 * (b.sp - f.p - 1) from b join f on f.entity_id = b.entity_id and f.n = b.n - 1)
 select f.entity_id, f.date, round(m + 1e-7, 3) as level, round(p, 6) as variance, round(sm + 1e-7, 3) as smoothed, round(sp, 6) as smoothed_variance from f join b using (entity_id, n)""")
def m8_series(s, d):
    found = scans.kalman_series(view(s, d, "target_daily"), ["entity_id"], "px", 1.0, 10.0)
    moved = found.withColumns({c: F.col(c) + 1e-7 for c in ("level", "smoothed")})
    return rounded(rounded(moved, "level", "smoothed", n=3), "variance", "smoothed_variance", n=6)


@query("m9_dynamic_pca")
def m9(s, d):
    wide = states_of(s, d).groupBy("date", "entity_id").pivot("state_name", ["cooperation", "material_conflict", "verbal_conflict"]).agg(F.sum("weighted_score")).fillna(0.0)
    fit = models.principal_components(models.assembled(wide, ["cooperation", "material_conflict", "verbal_conflict"]), 2)
    return s.createDataFrame([(i, float(v)) for i, v in enumerate(fit.explainedVariance.toArray())], "component int, share double").withColumn("share", F.round("share", 4))


@query("m9_window_pca", f"""with {STATES}, wide as (select date, entity_id, coalesce(sum(v) filter (where state_name = 'cooperation'), 0) as a, coalesce(sum(v) filter (where state_name = 'material_conflict'), 0) as b from states group by 1, 2),
 ends as (select distinct date_trunc('month', date)::date as month from wide), c as (select month, count(*) as n, var_samp(a) as aa, var_samp(b) as bb, covar_samp(a, b) as ab from ends join wide on date >= month - to_months(11) and date < month + to_months(1) group by 1 having count(*) >= 10),
 l as (select *, (aa + bb) / 2 + sqrt((aa - bb) ** 2 / 4 + ab * ab) as l1 from c), v as (select *, ab / sqrt(ab * ab + (l1 - aa) ** 2) as va, (l1 - aa) / sqrt(ab * ab + (l1 - aa) ** 2) as vb from l),
 o as (select *, case when va * lag(va) over w + vb * lag(vb) over w < 0 then 1 else 0 end as turn, first_value(case when abs(va) > abs(vb) then sign(va) else sign(vb) end) over w as lead from v window w as (order by month)),
 d as (select *, lead * case when sum(turn) over (order by month) % 2 = 1 then -1 else 1 end as s from o)
 select month, n, round(l1 / (aa + bb), 6) as share, round(s * va, 6) as cooperation, round(s * vb, 6) as material_conflict from d""")
def m9_windows(s, d):
    names = ["cooperation", "material_conflict"]
    wide = states_of(s, d).groupBy("date", "entity_id").pivot("state_name", names).agg(F.sum("weighted_score")).fillna(0.0)
    found = factors.window_components(wide, names, 12, 1)
    return rounded(found.select("month", "n", "share", *[F.get("loadings", F.lit(i)).alias(x) for i, x in enumerate(names)]), "share", *names, n=6)


@query("m10_score", f"with {PANEL} select date, entity_id, round(1.5 + 0.25 * x - 2.0 * n, 4) as p from panel")
def m10(s, d):
    return rounded(models.score(panel(s, d), {"x": 0.25, "n": -2.0}, 1.5), "p").select("date", "entity_id", "p")


@query("m11_baseline", "select date, entity_id, round(avg(px) over (partition by entity_id order by date rows between unbounded preceding and 1 preceding) + 1e-7, 3) as historic_mean, lag(px) over (partition by entity_id order by date) as last_value from target_daily")
def m11(s, d):
    return models.baseline(view(s, d, "target_daily"), ["entity_id"], "px").select("date", "entity_id", r(F.col("historic_mean") + 1e-7, 3).alias("historic_mean"), "last_value")


# --- validation
@query("v1_walk_forward_folds", """with e as (select min(date)::date as lo, max(date)::date as hi, (min(date) + to_months(36))::date as test from target_daily)
 select i::int as fold_id, lo as train_start, (test + to_months((6 * i)::int))::date as train_end, (test + to_months((6 * i)::int))::date as test_start, least((test + to_months((6 * i + 6)::int))::date, hi) as test_end from e, range(0, 200) t(i) where (test + to_months((6 * i)::int))::date < hi""")
def v1(s, d):
    return validation.folds_of(view(s, d, "target_daily"), 36)


PRED = """pred as (select entity_id, date, px / 1e5 as y, lag(px) over (partition by entity_id order by date) / 1e5 as p, avg(px) over (partition by entity_id) / 1e5 as train_mean from target_daily)"""


def predicted(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("entity_id")
    return view(s, d, "target_daily").select("entity_id", "date", (F.col("px") / 1e5).alias("y"), (F.lag("px").over(w.orderBy("date")) / 1e5).alias("p"), (F.avg("px").over(w) / 1e5).alias("train_mean")).filter("p is not null")


@query("v2_metrics_reg", f"with {PRED} select entity_id, round(1 - sum((y - p) ** 2) / sum((y - train_mean) ** 2), 4) as r2_oos, round(sqrt(avg((y - p) ** 2)), 4) as rmse, round(avg(abs(y - p)), 4) as mae from pred where p is not null group by 1")
def v2(s, d):
    return rounded(validation.metrics_reg(predicted(s, d), ["entity_id"]), "r2_oos", "rmse", "mae")


@query("v3_metrics_dir", f"with {PRED} select entity_id, round(avg((sign(p - 1.5) = sign(y - 1.5))::int), 4) as directional_accuracy, round(avg((sign(p - 1.5) = sign(y - 1.5))::int) filter (where p <> 1.5), 4) as hit_ratio from pred where p is not null group by 1")
def v3(s, d):
    moved = predicted(s, d).withColumns({"y": F.col("y") - 1.5, "p": F.col("p") - 1.5})
    return rounded(validation.metrics_dir(moved, ["entity_id"]), "directional_accuracy", "hit_ratio")


@query("v4_ic", f"""with {PRED}, k as (select date, rank() over (partition by date order by y) + (count(*) over (partition by date, y) - 1) / 2.0 as ry, rank() over (partition by date order by p) + (count(*) over (partition by date, p) - 1) / 2.0 as rp from pred where p is not null)
 select date, count(*) as n, round(corr(ry, rp), 4) as ic from k group by 1 having count(*) > 2""")
def v4(s, d):
    return rounded(validation.ic(predicted(s, d)), "ic").filter("n > 2")


@query("v5_metrics_cls", """with k as (select y, p, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rk from scored_label) select round(avg(-case when y = 1 then ln(greatest(1e-9, least(1 - 1e-9, p))) else ln(1 - greatest(1e-9, least(1 - 1e-9, p))) end), 6) as log_loss,
 round((sum(y * rk) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) as auc from k""")
def v5(s, d):
    return rounded(validation.metrics_cls(scored(s, d)), "log_loss", "auc", n=6)


@query("v6_calibration", "select least(floor(p * 10), 9)::int as bucket, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as mean_y from scored_label group by 1")
def v6(s, d):
    return rounded(validation.calibration(scored(s, d)), "mean_p", "mean_y", n=6)


@query("v6_brier", "select round(avg((p - y) * (p - y)), 6) as brier, round(regr_slope(y, p), 6) as calibration_slope from scored_label")
def v6b(s, d):
    return rounded(validation.brier(scored(s, d)), "brier", "calibration_slope", n=6)


@query("v7_coefficients")
def v7(s, d):
    df = panel(s, d)
    return rounded(models.panel_ols(df, "px", ["x", "n"], ["entity_id"]).table(df), "coef", "se", "t", "p", "ci_low", "ci_high")


@query("v8_placebo", """with e as (select run_id, date, entity_id, px from target_daily, (select unnest(range(0, 3))::int as run_id) ), a as (select *, row_number() over (partition by run_id order by entity_id, date) as n from e),
 b as (select run_id, px as x_placebo, row_number() over (partition by run_id order by md5(concat_ws('|', '7', run_id::varchar, concat_ws('|', entity_id, date::varchar))), entity_id, date) as n from e) select run_id, date, entity_id, px, x_placebo from a join b using (run_id, n)""")
def v8(s, d):
    return validation.placebo(view(s, d, "target_daily"), "px", ["entity_id", "date"], 3, 7).select("run_id", "date", "entity_id", "px", "x_placebo")


P_VALUES = "pv as (select p_partkey as id, p_brand as family, (p_partkey * 7919 % 1000 + 1) / 1001.0::double as p from part)"


def p_values(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("family"), ((F.col("p_partkey") * 7919 % 1000 + 1) / F.lit(1001.0)).alias("p"))


@query("v9_placebo_p", f"with {P_VALUES} select family, round((1 + count(*) filter (where abs(p) >= 0.6)) / (1 + count(*)), 6) as placebo_p from pv group by 1")
def v9(s, d):
    return rounded(validation.placebo_p(p_values(s, d).withColumn("observed", F.lit(0.6)), ["family"], "p", "observed"), "placebo_p", n=6)


@query("v10_bh_fdr", f"""with {P_VALUES}, k as (select *, count(*) over (partition by family) as m, row_number() over (partition by family order by p, id) as k from pv)
 select id, family, m as family_size, round(least(1.0, min(p * m / k) over (partition by family order by k desc rows unbounded preceding)), 6) as q from k""")
def v10(s, d):
    return validation.bh_fdr(p_values(s, d), "family", "p", "id").select("id", "family", "family_size", F.round("q", 6).alias("q"))


@query("v11_robustness_grid", f"""with {EV}, c as (select unnest([7, 14, 30]) as window_days), s as (select unnest(['all', 'even', 'odd']) as slice), day as (select slice, actor1_entity_id as entity_id, event_date as date, sum(w) as v from ev, s where slice = 'all' or (slice = 'even') = (replace(source_domain, 'src', '')::int % 2 = 0) group by 1, 2, 3),
 rolled as (select a.slice, c.window_days, a.entity_id, a.date, sum(b.v) as x from day a, c, day b where a.slice = b.slice and a.entity_id = b.entity_id and b.date <= a.date and b.date > a.date - c.window_days group by 1, 2, 3, 4)
 select slice || '/' || window_days as check_id, count(*) as n, round(regr_slope(px, x), 3) as slope from rolled join target_daily using (entity_id, date) group by 1""")
def v11(s, d):
    from presslens.operators.robustness import robustness_grid

    ev = events(s, d).withColumn("v", event_weight()).withColumn("even", F.replace("source_domain", F.lit("src"), F.lit("")).cast("int") % 2 == 0)
    checks = robustness_grid(ev, view(s, d, "target_daily"), {"all": F.lit(True), "even": F.col("even"), "odd": ~F.col("even")}, (7, 14, 30))
    return rounded(checks, "slope", n=3)


RUNS = """runs as (select p_partkey as run_id, 'H' || (p_partkey % 50) as hypothesis_id, (p_size % 10) / 10.0::double as predictive_power, (p_size % 7) / 7.0::double as calibration, (p_size % 5) / 5.0::double as stability, (p_size % 3)::double as complexity, p_retailprice as data_cost,
 (p_partkey % 20) / 100.0::double as q, case when p_partkey % 3 = 0 then -1.0 else 1.0 end as sign, 1.0 as expected_sign, (p_partkey % 11) / 10.0::double as sign_stability, (p_partkey % 9 - 3) / 10.0::double as r2_oos, 0.2::double as r2_train, (p_partkey % 13) / 100.0::double as placebo_p, (p_partkey % 4) as slices_passed, (p_partkey % 5) as folds_positive,
 p_partkey % 17 <> 0 as mapping_ok, p_partkey % 19 <> 0 as data_ok, p_partkey % 23 <> 0 as feature_ok, p_partkey % 29 <> 0 as cost_ok from part)"""


def typed_runs(s, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(s, d, "part").select(
        k.alias("run_id"), F.concat(F.lit("H"), (k % 50).cast("string")).alias("hypothesis_id"), ((size % 10) / F.lit(10.0)).alias("predictive_power"), ((size % 7) / F.lit(7.0)).alias("calibration"),
        ((size % 5) / F.lit(5.0)).alias("stability"), (size % 3).cast("double").alias("complexity"), F.col("p_retailprice").alias("data_cost"), ((k % 20) / F.lit(100.0)).alias("q"),
        F.when(k % 3 == 0, -1.0).otherwise(1.0).alias("sign"), F.lit(1.0).alias("expected_sign"), ((k % 11) / F.lit(10.0)).alias("sign_stability"), ((k % 9 - 3) / F.lit(10.0)).alias("r2_oos"), F.lit(0.2).alias("r2_train"),
        ((k % 13) / F.lit(100.0)).alias("placebo_p"), (k % 4).alias("slices_passed"), (k % 5).alias("folds_positive"), (k % 17 != 0).alias("mapping_ok"), (k % 19 != 0).alias("data_ok"), (k % 23 != 0).alias("feature_ok"), (k % 29 != 0).alias("cost_ok"),
    )


SCALED = " + ".join(f"{w} * coalesce((r.{c} - lo.{c}) / nullif(hi.{c} - lo.{c}, 0), 0)" for c, w in validation.SCORE_WEIGHTS.items())


@query("v13_composite_score", f"with {RUNS}, lo as (select {', '.join(f'min({c}) as {c}' for c in validation.SCORE_WEIGHTS)} from runs), hi as (select {', '.join(f'max({c}) as {c}' for c in validation.SCORE_WEIGHTS)} from runs) select run_id, round({SCALED}, 4) as score from runs r, lo, hi")
def v13(s, d):
    return rounded(validation.composite_score(typed_runs(s, d)), "score").select("run_id", "score")


REASON = """case when not mapping_ok then 'bad_entity_mapping' when not data_ok then 'data_quality' when not feature_ok then 'ambiguous_feature' when not cost_ok then 'cost_excessive' when q >= 0.1 then 'no_signal' when sign <> expected_sign then 'wrong_sign'
 when placebo_p >= 0.05 then 'placebo_fail' when r2_train > 0 and r2_oos <= 0 then 'overfit' when sign_stability < 0.8 then 'unstable' end"""
VERDICT = """case when q < 0.1 and sign = expected_sign and sign_stability >= 0.8 and r2_oos > 0 and placebo_p < 0.05 and slices_passed >= 2 then 'supported' when (q < 0.1 and sign <> expected_sign) or folds_positive = 0 then 'rejected' else 'inconclusive' end"""


@query("v14_failure_reason", f"with {RUNS} select run_id, {REASON} as reason from runs")
def v14(s, d):
    return typed_runs(s, d).select("run_id", validation.failure_reason().alias("reason"))


@query("v15_decide", f"with {RUNS} select run_id, {VERDICT} as verdict from runs")
def v15(s, d):
    return typed_runs(s, d).select("run_id", validation.decide().alias("verdict"))


@query("v12_one_slice_only", f"with {RUNS} select hypothesis_id, count(*) filter (where slices_passed = 1) as one_slice, count(*) filter (where {VERDICT} = 'supported' and slices_passed < 2) as wrongly_supported from runs group by 1")
def v12(s, d):
    runs = typed_runs(s, d).withColumn("verdict", validation.decide())
    return runs.groupBy("hypothesis_id").agg(F.count_if(F.col("slices_passed") == 1).alias("one_slice"), F.count_if((F.col("verdict") == "supported") & (F.col("slices_passed") < 2)).alias("wrongly_supported"))


@query("v16_hypothesis_tree", """with recursive h as (select s_suppkey as id, case when s_suppkey > 5 then s_suppkey // 3 + 1 end as parent_id from supplier), t(id, root, depth) as (select id, id, 0 from h where parent_id is null union all select h.id, t.root, t.depth + 1 from t join h on h.parent_id = t.id) select id, root, depth::int as depth from t""")
def v16(s, d):
    k = F.col("s_suppkey")
    h = table(s, d, "supplier").select(k.alias("id"), F.when(k > 5, F.floor(k / 3) + 1).cast("long").alias("parent_id"))
    return validation.hypothesis_tree(s, h)


@query("v17_prior_failures", """with h as (select s_suppkey as id, s_suppkey // 8 as f, s_suppkey % 2 as t from supplier) select 'x' || (a.f) as feature, 'y' || (a.t) as target, a.id as asked_id, b.id as hypothesis_id, 'no_signal' as failure_reason from h a join h b on a.f = b.f and a.t = b.t and a.id <> b.id where b.id % 3 > 0""")
def v17(s, d):
    k = F.col("s_suppkey")
    spec = F.to_json(F.struct(F.concat(F.lit("x"), F.floor(k / 8).cast("string")).alias("feature"), F.concat(F.lit("y"), (k % 2).cast("string")).alias("target")))
    h = table(s, d, "supplier").select(k.alias("hypothesis_id"), spec.alias("spec_json"), F.lit("no_signal").alias("failure_reason"))
    return validation.prior_failures(h.filter("hypothesis_id % 3 > 0"), h)


@query("v18_compare", "select p_brand as run_id, max(p_retailprice) filter (where p_size <= 25) as rmse, max(p_retailprice) filter (where p_size > 25) as auc from part group by 1")
def v18(s, d):
    metrics = table(s, d, "part").select(F.col("p_brand").alias("run_id"), F.when(F.col("p_size") <= 25, "rmse").otherwise("auc").alias("metric"), F.col("p_retailprice").alias("value"))
    return validation.compare(metrics, ["rmse", "auc"])


@query("v19_check_specs", """select p_partkey as spec_id, array_to_string(list_filter([case when p_partkey % 6 - 1 < 0 then 'negative_lag' end, case when p_partkey % 4 <= 0 then 'no_horizon' end, case when p_size > 4000 then 'train_after_test' end, case when 2000 + p_size * 40 > 3650 then 'too_many_days' end, case when p_size * 3 > 100 then 'too_many_entities' end,
 case when p_partkey % 5 = 4 then 'unknown_model' end, case when p_type not in (select p_type from part where p_size > 45) then 'unregistered_id' end], lambda x: x is not null), '+') as reasons from part""")
def v19(s, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    start = F.lit("2000-01-01").cast("date")
    specs = table(s, d, "part").select(k.alias("spec_id"), (k % 6 - 1).alias("lag"), (k % 4).alias("horizon"), start.alias("train_start"), F.date_add(start, 1000).alias("test_start"), F.date_add(start, 2000 + size * 40).alias("test_end"), (size * 3).alias("n_entities"), F.element_at(F.array(*map(F.lit, ["panel_ols", "logit", "poisson", "negbin", "forest"])), (k % 5 + 1).cast("int")).alias("model"), F.col("p_type").alias("feature_id"))
    return validation.check_specs(specs, registry=table(s, d, "part").filter("p_size > 45").select(F.col("p_type").alias("id"))).select("spec_id", F.array_join("reasons", "+").alias("reasons"))


@query("v20_estimate_cost", "select coalesce(sum(n), 0)::bigint as rows, count(distinct date) as dates, count(*) as partitions, count(distinct date) * 25 as panel_rows from (select event_date as date, source_domain, count(*) as n from world_event group by 1, 2) where date between date '1994-01-01' and date '1995-12-31'")
def v20(s, d):
    stats = view(s, d, "world_event").groupBy(F.col("event_date").alias("date"), "source_domain").agg(F.count("*").alias("rows"))
    return validation.estimate_cost(stats, "1994-01-01", "1995-12-31", 25)


STATUS = ["draft", "compiled", "queued", "running", "supported", "rejected"]


@query("v21_illegal_transitions", f"""with l as (select 'H' || o_custkey as hypothesis_id, o_orderkey as seq, {STATUS}[(o_orderkey % 6 + 1)::int] as status from orders), s as (select *, lag(status) over (partition by hypothesis_id order by seq) as before from l)
 select hypothesis_id, seq, before, status from s where before is not null and before <> status and (before, status) not in (('draft', 'compiled'), ('compiled', 'queued'), ('queued', 'running'), ('running', 'supported'), ('running', 'rejected'), ('running', 'inconclusive'))""")
def v21(s, d):
    log = table(s, d, "orders").select(F.concat(F.lit("H"), F.col("o_custkey").cast("string")).alias("hypothesis_id"), F.col("o_orderkey").alias("seq"), F.element_at(F.array(*map(F.lit, STATUS)), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("status"))
    return validation.illegal_transitions(log).select("hypothesis_id", "seq", "before", "status")


@query("v22_run_report", f"with {RUNS} select run_id, 'q' as metric, q as value from runs union all select run_id, 'r2_oos', r2_oos from runs union all select run_id, 'placebo_p', placebo_p from runs")
def v22(s, d):
    return validation.run_report(typed_runs(s, d), ["q", "r2_oos", "placebo_p"])


@query("v23_sensitivity", """with g as (select unnest([0.4, 0.5, 0.6])::double as a), t as (select a, actor1_entity_id as entity_id, sum(pow(ln(1 + num_mentions), a)) as v from world_event, g group by 1, 2) select entity_id, round((max(v) filter (where a = 0.6) - max(v) filter (where a = 0.4)) / 0.2, 3) as slope from t group by 1""")
def v23(s, d):
    from presslens.operators.robustness import sensitivity

    return rounded(sensitivity(view(s, d, "world_event"), "actor1_entity_id", "num_mentions", (0.4, 0.5, 0.6)), "slope", n=3)


GRAD = {
    "mentions_power": "v * ln(ln(1 + num_mentions))", "sources_power": "v * ln(1 + num_sources)", "goldstein_weight": "v / (1 + 0.6 * abs(goldstein) / 10) * abs(goldstein) / 10",
    "tone_weight": "v / (1 + 0.4 * h) * h", "tone_scale": "v / (1 + 0.4 * h) * 0.4 * (1 - h * h) * avg_tone / 100", "half_life_days": "v * age * ln(2) / (14.0 * 14.0)",
}


@query("v23_index_gradient", f"""with {EV}, x as (select *, tanh(-avg_tone / 10) as h, date '1997-06-30' - event_date as age, case relation_id when 'cooperation' then -1 else 1 end as sign from ev where relation_id in {tuple(TENSION_WEIGHTS)} and event_date <= date '1997-06-30'), y as (select *, w * exp(-age * ln(2) / 14.0) as v from x)
 select actor1_entity_id as entity_id, round(sum(sign * v), 4) as "index", {", ".join(f"round(sum(sign * {sql}), 4) as d_{name}" for name, sql in GRAD.items())}, {", ".join(f"round(coalesce(sum(v) filter (where relation_id = '{name}'), 0), 4) as d_{name}" for name in TENSION_WEIGHTS)} from y group by 1""")
def v23_gradient(s, d):
    from presslens.operators.robustness import index_gradient

    found = index_gradient(events(s, d), "actor1_entity_id", "1997-06-30")
    return rounded(found, *found.columns[1:])


# --- data quality
def check(name, sql, f):
    query(name, sql)(f)


def verdict_sql(check_id, value, source, threshold, at_most=True):
    return f"select '{check_id}' as check_id, ({value})::double {'<=' if at_most else '>='} {threshold} as passed, ({value})::double as value, {float(threshold)}::double as threshold from {source}"


def we(s, d):
    return view(s, d, "world_event")


check("q1_rows", verdict_sql("rows", "count(*)", "world_event", 1, False), lambda s, d: quality.check_rows(we(s, d)))
check("q1_date_range", verdict_sql("date_range", "count(*) filter (where not event_date between date '1993-01-01' and date '1997-12-31')", "world_event", 0), lambda s, d: quality.check_dates(we(s, d), "event_date", "1993-01-01", "1997-12-31"))
check("q2_duplicate_files", verdict_sql("duplicate_files", "coalesce(sum(n - 1) filter (where n > 1), 0)", "(select count(*) as n from documents group by sha256(text))", 0), lambda s, d: quality.check_unique(table(s, d, "documents").select(F.sha2("text", 256).alias("sha")), ["sha"], "duplicate_files"))
check("q3_event_id_unique", verdict_sql("unique", "coalesce(sum(n - 1) filter (where n > 1), 0)", "(select count(*) as n from world_event group by source_event_id)", 0), lambda s, d: quality.check_unique(we(s, d), ["source_event_id"]))
check("q4_mapping_rate", verdict_sql("mapping_rate", "avg((n_nationkey is not null)::int)", "world_event left join nation on actor1_entity_id = 'COUNTRY_' || n_nationkey and n_nationkey < 20", 0.9, False), lambda s, d: quality.check_rate(silver.crosswalk(we(s, d), table(s, d, "nation").filter("n_nationkey < 20").select(F.concat(F.lit("COUNTRY_"), "n_nationkey").alias("code"), "n_name"), "actor1_entity_id", "code", "n_name"), F.col("n_name").isNotNull(), "mapping_rate", 0.9))
check("q5_relation_rate", f"with {EV} " + verdict_sql("relation_rate", "avg((relation_id <> 'unknown')::int)", "ev", 0.95, False), lambda s, d: quality.check_rate(events(s, d), F.col("relation_id") != "unknown", "relation_rate", 0.95))
check("q6_date_added", verdict_sql("date_added", "count(*) filter (where date_added < event_date or date_added > event_date + 30)", "world_event", 0), lambda s, d: quality.check_none(we(s, d), ~F.date_diff("date_added", "event_date").between(0, 30), "date_added"))
check("q7_tone_range", verdict_sql("tone_range", "count(*) filter (where not avg_tone between -100 and 100)", "world_event", 0), lambda s, d: quality.check_none(we(s, d), ~F.col("avg_tone").between(-100, 100), "tone_range"))
check("q7_goldstein_range", verdict_sql("goldstein_range", "count(*) filter (where not goldstein between -8 and 8)", "world_event", 0), lambda s, d: quality.check_none(we(s, d), ~F.col("goldstein").between(-8, 8), "goldstein_range"))
check("q8_every_date", verdict_sql("missing_dates", "coalesce(sum(missing), 0)", "(select max(date) - min(date) + 1 - count(distinct date) as missing from target_daily group by entity_id)", 0), lambda s, d: quality.check_complete(view(s, d, "target_daily"), "date", ["entity_id"]))
check("q9_zscore_not_null", f"with {DENSE}, z as (select entity_id, case when count(v) over w >= 90 then 1 end as z from dense window w as (partition by entity_id order by date range between interval 365 days preceding and interval 8 days preceding)) " + verdict_sql("zscore", "count(*) filter (where n = 0)", "(select entity_id, count(z) as n from z group by 1)", 0), lambda s, d: quality.check_groups_have(windows.seasonal_z(daily_dense(s, d), ["entity_id"], "v"), ["entity_id"], "zscore", "zscore"))
check("q10_winsorised", f"with {DENSE}, b as (select entity_id, quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.99) as hi from dense where date < date '1996-01-01' group by 1) " + verdict_sql("winsorised", "count(*) filter (where v > hi or v < lo)", "dense join b using (entity_id)", 0), lambda s, d: q10(s, d))


def q10(s, d):
    dense = daily_dense(s, d)
    clipped = windows.winsorize(dense, ["entity_id"], "v", "c", "1996-01-01")
    return quality.check_none(clipped, F.col("v") != F.col("c"), "winsorised")


def rolled_sql(source):
    return f"""select date, src_entity_id, dst_entity_id, relation_id, mention_count, sum(mention_count) over (partition by src_entity_id, dst_entity_id, relation_id order by date range between interval 29 days preceding and current row) as rolled
 from (select event_date as date, actor1_entity_id as src_entity_id, actor2_entity_id as dst_entity_id, relation_id, sum(num_mentions) as mention_count from {source} group by 1, 2, 3, 4)"""


@query("q11_no_future", f"""with {EV}, whole as ({rolled_sql("ev")}), early as ({rolled_sql("(select * from ev where event_date <= date '1995-06-30')")}), cut as (select * from whole where date <= date '1995-06-30')
 select 'no_future' as check_id, count(*) <= 0 as passed, count(*)::double as value, 0.0::double as threshold from ((select * from cut except all select * from early) union all (select * from early except all select * from cut))""")
def q11(s, d):
    def build(df):
        return rounded(windows.rolling_sum(gold.pair_day_relation(df), ["src_entity_id", "dst_entity_id", "relation_id"], "mention_count", 30, "rolled"), "weighted_score").select("date", "src_entity_id", "dst_entity_id", "relation_id", "mention_count", "rolled")

    ev = events(s, d)
    return quality.check_same(build(ev).filter("date <= '1995-06-30'"), build(ev.filter("event_date <= '1995-06-30'")), "no_future")


check("q12_versions", verdict_sql("versions", "count(*) filter (where p_size % 10 = 0)", "part", 0), lambda s, d: quality.check_none(table(s, d, "part").withColumn("param_version", F.when(F.col("p_size") % 10 != 0, "p1")), F.col("param_version").isNull(), "versions"))
check("q14_references", verdict_sql("references", "count(*)", "(select distinct p_brand, p_type from part where p_type not in (select p_type from part where p_size > 45))", 0), lambda s, d: q14(s, d))


def q14(s, d):
    from presslens.operators.joins import missing_refs

    part = table(s, d, "part")
    return quality.check_none(missing_refs(part.groupBy(F.col("p_brand").alias("spec_id")).agg(F.collect_set("p_type").alias("refs")), part.filter("p_size > 45").select(F.col("p_type").alias("id"))), F.lit(True), "references")


@query("q13_splits", "select 'splits' as check_id, count(*) filter (where p_partkey % 6 - 1 < 0 or p_partkey % 4 <= 0) <= 0 as passed, (count(*) filter (where p_partkey % 6 - 1 < 0 or p_partkey % 4 <= 0))::double as value, 0.0::double as threshold from part")
def q13(s, d):
    return quality.check_none(table(s, d, "part"), (F.col("p_partkey") % 6 - 1 < 0) | (F.col("p_partkey") % 4 <= 0), "splits")


@query("q15_null_rates", "with n as (select avg((vec_id is null)::int) as vec_id, avg((label is null)::int) as label, avg((case when label % 2 = 0 then label end is null)::int) as even_label from embeddings) select 'vec_id' as \"column\", round(vec_id, 6) as null_rate from n union all select 'label', round(label, 6) from n union all select 'even_label', round(even_label, 6) from n")
def q15(s, d):
    df = table(s, d, "embeddings").select("vec_id", "label", F.when(F.col("label") % 2 == 0, F.col("label")).alias("even_label"))
    return rounded(quality.null_rates(df), "null_rate", n=6)


@query("q16_audit_sample", "select source_event_id, source_url from world_event where md5(source_event_id) like '0a%'")
def q16(s, d):
    return quality.audit_sample(we(s, d), "source_event_id", "0a").select("source_event_id", "source_url")


@query("q17_volume_drift", """with v as (select event_date as date, source_domain as entity_id, count(*)::double as v from world_event group by 1, 2) select date, entity_id, round(case when count(v) over w >= 20 then (v - avg(v) over w) / (stddev_samp(v) over w + 1e-6) end, 3) as zscore from v window w as (partition by entity_id order by date range between interval 365 days preceding and interval 8 days preceding)""")
def q17(s, d):
    daily = we(s, d).groupBy(F.col("event_date").alias("date"), F.col("source_domain").alias("entity_id")).agg(F.count("*").cast("double").alias("v"))
    return windows.seasonal_z(daily, ["entity_id"], "v", min_periods=20).select("date", "entity_id", r("zscore", 3).alias("zscore"))


# --- the read API
@query("k1_world_state", f"with {STATES} select date, entity_id, state_name, round(v, 4) as weighted_score from states where entity_id = 'COUNTRY_3' and state_name = 'cooperation' and date between date '1994-01-01' and date '1996-12-31'")
def k1(s, d):
    return rounded(api.get_world_state(states_of(s, d), "COUNTRY_3", "cooperation", "1994-01-01", "1996-12-31"), "weighted_score").select("date", "entity_id", "state_name", "weighted_score")


@query("p5_state_predicates", f"with {STATES} select date, entity_id, state_name, round(v, 4) as weighted_score from states where date between date '1995-01-01' and date '1995-03-31' and state_name = 'material_conflict'")
def p5(s, d):
    return rounded(states_of(s, d).filter(api.between("1995-01-01", "1995-03-31") & (F.col("state_name") == "material_conflict")), "weighted_score").select("date", "entity_id", "state_name", "weighted_score")


@query("k2_relation_timeseries", f"with {EV}, {PAIRS} select date, event_count, mention_count from pairs where src_entity_id = 'COUNTRY_1' and dst_entity_id = 'COUNTRY_2' and relation_id = 'cooperation' and date between date '1993-01-01' and date '1998-12-31'")
def k2(s, d):
    return api.get_relation_timeseries(pairs_of(s, d), "COUNTRY_1", "COUNTRY_2", "cooperation", "1993-01-01", "1998-12-31").select("date", "event_count", "mention_count")


@query("k3_search_evidence", "select article_id, source_domain, language from world_article where regexp_matches(lower(text), 'license') and published_ts >= timestamp '2024-01-01' and published_ts < timestamp '2024-01-12' order by article_id limit 10000")
def k3(s, d):
    api.guard("2024-01-01", "2024-01-12")
    found = view(s, d, "world_article").filter(F.lower("text").contains("license") & (F.col("published_ts") >= "2024-01-01") & (F.col("published_ts") < "2024-01-12"))
    return api.page(found.select("article_id", "source_domain", "language"), "article_id", None, 10_000)


@query("k3_search_ranked", r"""with d as (select article_id, list_filter(regexp_split_to_array(lower(concat_ws(' ', text, theme_id, source_domain, entity_id)), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from world_article where published_ts >= timestamp '2024-01-01' and published_ts < timestamp '2024-01-12'),
 c as (select article_id, len(w) as n, len(list_filter(w, lambda x: x = 'license')) as t0, len(list_filter(w, lambda x: x = 'country')) as t1 from d), s as (select count(*) as docs, avg(n) as avg_len, count(*) filter (where t0 > 0) as d0, count(*) filter (where t1 > 0) as d1 from c)
 select article_id, round(ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / avg_len)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / avg_len)), 6) as score from c, s where t0 > 0 or t1 > 0 order by score desc, article_id limit 100""")
def k3_ranked(s, d):
    return api.search(view(s, d, "world_article"), ["license", "country"], "2024-01-01", "2024-01-12", 100, fields=("text", "theme_id", "source_domain", "entity_id"))


@query("k4_entity_theme_pressure", f"with {EV}, {BOTH} select event_date as date, count(*) as article_count, count(distinct source_domain) as source_count from both_ends where entity_id = 'COUNTRY_5' and theme_id = (select min(theme_id) from world_event) and event_date between date '1993-01-01' and date '1998-12-31' group by 1")
def k4(s, d):
    ev = we(s, d)
    theme = ev.agg(F.min("theme_id")).first()[0]
    return api.entity_theme_pressure(gold.entity_theme_day(ev), "COUNTRY_5", theme, "1993-01-01", "1998-12-31").select("date", "article_count", "source_count")


@query("k5_top_evidence", f"with {EV} select source_event_id, source_url, round(w, 4) as w from ev where actor1_entity_id = 'COUNTRY_1' and relation_id = 'protest_pressure' and event_date between date '1995-01-01' and date '1995-12-31' order by round(w, 4) desc, source_event_id, source_url limit 10")
def k5(s, d):
    api.guard("1995-01-01", "1995-12-31", ["COUNTRY_1"])
    cell = events(s, d).filter(api.between("1995-01-01", "1995-12-31", "event_date") & (F.col("actor1_entity_id") == "COUNTRY_1") & (F.col("relation_id") == "protest_pressure"))
    return cell.select("source_event_id", "source_url", r(event_weight()).alias("w")).orderBy(F.desc("w"), "source_event_id", "source_url").limit(10)


@query("k6_hypothesis_result", f"with {RUNS} select run_id, {VERDICT} as verdict from runs where hypothesis_id = 'H7'")
def k6(s, d):
    return api.get_hypothesis_result(typed_runs(s, d), "H7").select("run_id", validation.decide().alias("verdict"))


@query("k7_versions", "select o_orderpriority as name, arg_max(o_orderstatus || o_orderkey, (o_orderdate, o_orderstatus || o_orderkey)) as version, count(*) as n from orders group by 1")
def k7(s, d):
    registry = table(s, d, "orders").select(F.col("o_orderpriority").alias("name"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("v"), "o_orderdate")
    return api.latest_versions(registry, "name", "v", "o_orderdate")


@query("k8_row_cap", "select l_orderkey, l_linenumber from lineitem order by l_orderkey, l_linenumber limit 10000")
def k8(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber").limit(10_000)


# --- streams, each run to its end
def event_stream(s, d):
    source = table(s, d, "events")
    return streams.stream_files(s, f"{d}/events.parquet*", source.schema)


def ran(df, mode="append"):
    at = f"{own_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    return streams.run_to_table(df, f"{at}/table", f"{at}/checkpoint", mode)


for grain, sql in (("15 minutes", "time_bucket(interval '15 minutes', ts)"), ("1 hour", "date_trunc('hour', ts)"), ("1 day", "date_trunc('day', ts)")):
    query(f"r2_stream_counts_{grain.replace(' ', '_')}", f"select epoch(({sql})::timestamp)::bigint as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")(
        lambda s, d, g=grain: ran(streams.stream_counts(event_stream(s, d), g), "complete").select(F.unix_timestamp("start").alias("start"), "event_type", "n", r("total").alias("total"))
    )


@query("r3_stream_sliding", "select epoch(time_bucket(interval '1 day', ts)::timestamp - to_days(i::int))::bigint as start, event_type, count(*) as n, round(sum(value), 4) as total from events, range(0, 7) t(i) group by 1, 2")
def r3(s, d):
    return ran(streams.stream_counts(event_stream(s, d), "7 days", "1 day"), "complete").select(F.unix_timestamp("start").alias("start"), "event_type", "n", r("total").alias("total"))


@query("r4_late_corrections", """with h as (select max(ts) - interval 1 day as horizon from events where user_id % 10 <> 3) select ts::date as date, event_type, count(*) as n, round(sum(value), 4) as total, count(*) filter (where user_id % 10 = 3 and ts < horizon) as late from events, h group by 1, 2""")
def r4(s, d):
    """Every tenth user's events come after all others, most of them behind the watermark."""
    at = f"{own_dir(s)}/late-{uuid.uuid4().hex}"
    sent = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("date", F.to_date("ts"))
    for behind in (F.col("user_id") % 10 != 3, F.col("user_id") % 10 == 3):
        sent.filter(behind).write.mode("append").parquet(f"{at}/sent")
        streams.stream_corrected(streams.stream_files(s, f"{at}/sent", sent.schema), f"{at}/table", f"{at}/checkpoint", ["event_type"], {"n": F.count("*"), "total": F.sum("value")}, "1 day")
    late = s.read.parquet(f"{at}/table/late").groupBy("date", "event_type").agg(F.count("*").alias("late"))
    found = streams.corrected(s, f"{at}/table", "gold").join(late, ["date", "event_type"], "left").fillna(0, ["late"])
    return found.select("date", "event_type", "n", r("total").alias("total"), "late")


@query("r5_stream_dedupe", "select user_id, event_type, 1::bigint as n from events group by 1, 2")
def r5(s, d):
    kept = ran(streams.stream_dedupe(event_stream(s, d), ["user_id", "event_type"], "365 days"))
    return kept.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("r6_stream_enrich", "select n_name, count(*) as n from events left join nation on user_id % 25 = n_nationkey group by 1")
def r6(s, d):
    said = event_stream(s, d).withColumn("n_nationkey", (F.col("user_id") % 25).cast("int"))
    return ran(streams.stream_enrich(said, table(s, d, "nation"), "n_nationkey").groupBy("n_name").agg(F.count("*").alias("n")), "complete")


@query("r9_stream_sessions", """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as new from events), g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e)
 select user_id, epoch(date_trunc('second', min(ts)))::bigint as start, count(*) as n from g group by user_id, k""")
def r9(s, d):
    return ran(streams.stream_sessions(event_stream(s, d)), "complete").select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query("r8_stream_decay", "with m as (select event_type, max(ts) as last from events group by 1) select event_type as key, epoch(last)::double as at, round(sum(value * exp(-(epoch(last) - epoch(ts)) / (14 / ln(2) * 86400))), 4) as level from events join m using (event_type) group by 1, 2")
def r8(s, d):
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(setting)
    s.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return rounded(ran(streams.stream_decay(event_stream(s, d), "event_type"), "update"), "level")
    finally:
        s.conf.set(setting, before)


@query("r10_stream_join", "select e.event_id, e.event_type from events e join events m on m.event_id = e.event_id and m.ts + interval 10 minutes between e.ts and e.ts + interval 30 minutes")
def r10(s, d):
    mentions = event_stream(s, d).select(F.col("event_id").alias("of_event_id"), (F.col("ts") + F.expr("interval 10 minutes")).alias("mention_ts"))
    return ran(streams.stream_join(event_stream(s, d), mentions, "30 minutes")).select("event_id", "event_type")
