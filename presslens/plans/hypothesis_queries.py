"""Queries that test hypotheses on the given tables, with DuckDB twins that refit every model from its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.config import DEFAULT, SCORE_WEIGHTS
from presslens.functions.weights import event_weight, mention_damp
from presslens.operators import gold, hypotheses, validation
from presslens.plans.catalog import query
from presslens.plans.tables_queries import BOTH, EV, events, rounded
from presslens.sources.fixtures import table, view

#: Relations whose daily weight is the feature, and the sign that its slope is expected to have.
FEATURES = {"cooperation": 1.0, "material_conflict": -1.0, "protest_pressure": -1.0, "verbal_conflict": -1.0}
WINDOWS, HORIZONS, RUNS, SEED = (7, 14, 30), (1, 5, 20), 20, 7
BASE, HORIZON = ("window", "14"), 5


def daily_features(s: SparkSession, d: str) -> DataFrame:
    """(feature_id, entity_id, date, v, exposure, v_local, v_foreign): weights by day, of all sources, those of the entity's own country and the others."""
    local = F.replace("source_domain", F.lit("src"), F.lit("COUNTRY_")) == F.col("entity_id")
    ends = gold.endpoints(events(s, d).withColumn("w", event_weight())).withColumn("local", local)
    kind = F.col("relation_id")
    totals = {f"{name}_{f}": F.sum(F.when((kind == f) & stay, F.col("w")).otherwise(0.0)) for f in FEATURES for name, stay in (("v", F.lit(True)), ("v_local", F.col("local")), ("v_foreign", ~F.col("local")))}
    days = ends.groupBy("entity_id", F.col("event_date").alias("date")).agg(F.sum(mention_damp(F.col("num_mentions"))).alias("exposure"), *[c.alias(n) for n, c in totals.items()])
    rows = [F.struct(F.lit(f).alias("feature_id"), *[F.col(f"{n}_{f}").alias(n) for n in ("v", "v_local", "v_foreign")]) for f in FEATURES]
    return days.withColumn("f", F.explode(F.array(*rows))).select("f.*", "entity_id", "date", "exposure")


def regions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select(F.concat(F.lit("COUNTRY_"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.col("n_regionkey").cast("string").alias("region"))


def starts(targets: DataFrame) -> list[str]:
    """First days of the test windows: half a year each, after three years. As many as half-years."""
    return [str(r["test_start"]) for r in validation.folds_of(targets, 36).orderBy("fold_id").select("test_start").collect()]


def specs(s: SparkSession) -> DataFrame:
    rows = [(f, n, h, f, sign) for f, sign in FEATURES.items() for n in WINDOWS for h in HORIZONS]
    return s.createDataFrame(rows, "feature_id string, window_days int, horizon int, family string, expected_sign double")


def panel(s: SparkSession, d: str, values: tuple[str, ...] = ("v",), windows: tuple[int, ...] = WINDOWS, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    return hypotheses.feature_panel(daily_features(s, d), view(s, d, "target_daily"), list(FEATURES), values, windows, horizons)


# --- the same in SQL, from rows
NAMES = ", ".join(f"'{f}'" for f in FEATURES)
TARGETS = "t as (select entity_id, date, px / lag(px) over w - 1 as momentum, " + ", ".join(f"lead(px, {h}) over w / px - 1 as y_{h}, lead(date, {h}) over w as y_date_{h}" for h in HORIZONS) + " from target_daily window w as (partition by entity_id order by date))"
LOCAL = "replace(source_domain, 'src', 'COUNTRY_') = entity_id"
DAYS = f"days as (select entity_id, relation_id as feature_id, event_date as date, sum(w) as v, coalesce(sum(w) filter (where {LOCAL}), 0) as v_local, coalesce(sum(w) filter (where not {LOCAL}), 0) as v_foreign from both_ends group by 1, 2, 3)"


def rolled_sql(value: str, n: int) -> str:
    return f"coalesce(sum(d.{value}) filter (where d.date >= t.date - {n}), 0) as {value}_{n}"


PANEL = f"""{EV}, {BOTH}, {TARGETS}, {DAYS}, f as (select unnest([{NAMES}]) as feature_id),
 panel as (select f.feature_id, t.*, {', '.join(rolled_sql('v', n) for n in WINDOWS)}, {rolled_sql('v_local', 14)}, {rolled_sql('v_foreign', 14)}
 from t cross join f left join days d on d.entity_id = t.entity_id and d.feature_id = f.feature_id and d.date between t.date - {max(WINDOWS)} and t.date - 1 group by all)"""


def obs_sql(name: str, source: str, more: str = "") -> str:
    x = "case n " + " ".join(f"when {n} then v_{n}" for n in WINDOWS) + " end"
    y, known = ("case h " + " ".join(f"when {h} then {c}_{h}" for h in HORIZONS) + " end" for c in ("y", "y_date"))
    return f"""{name} as (select * from (select {more}feature_id, n::int as window_days, h::int as horizon, entity_id, date, momentum, {x} as x, {y} as y, {known} as y_date
 from {source}, (select unnest([{', '.join(map(str, WINDOWS))}]) as n), (select unnest([{', '.join(map(str, HORIZONS))}]) as h)) where y is not null and momentum is not null)"""


def fit_sql(name: str, source: str, keys: str) -> str:
    """CTE ``name`` (keys, n, g, b, c, se, t, rss, tss): least squares of y on x and momentum within entities, errors clustered by entity."""
    on = " and ".join(f"m.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    mine = ", ".join(f"m.{k.strip()}" for k in keys.split(","))
    return f"""{name}_m as (select {keys}, entity_id, x - avg(x) over w as x, momentum - avg(momentum) over w as c, y - avg(y) over w as y from {source} window w as (partition by {keys}, entity_id)),
 {name}_s as (select {keys}, count(*) as n, count(distinct entity_id) as g, sum(x * x) as xx, sum(c * c) as cc, sum(x * c) as xc, sum(x * y) as xy, sum(c * y) as cy, sum(y * y) as yy, sum(x * x) * sum(c * c) - sum(x * c) * sum(x * c) as det from {name}_m group by {keys}),
 {name}_u as (select {mine}, m.entity_id, sum(m.x * (m.y - (s.xy * s.cc - s.cy * s.xc) / det * m.x - (s.cy * s.xx - s.xy * s.xc) / det * m.c)) as ux, sum(m.c * (m.y - (s.xy * s.cc - s.cy * s.xc) / det * m.x - (s.cy * s.xx - s.xy * s.xc) / det * m.c)) as uc,
  sum((m.y - (s.xy * s.cc - s.cy * s.xc) / det * m.x - (s.cy * s.xx - s.xy * s.xc) / det * m.c) ** 2) as rss from {name}_m m join {name}_s s on {on} group by all),
 {name}_v as (select {mine}, sum(((s.cc * m.ux - s.xc * m.uc) / s.det) ** 2) as v, sum(rss) as rss from {name}_u m join {name}_s s on {on} group by all),
 {name} as (select {', '.join(f's.{k.strip()}' for k in keys.split(','))}, n, g, (xy * cc - cy * xc) / det as b, (cy * xx - xy * xc) / det as c, sqrt(v * g / (g - 1)) as se, (xy * cc - cy * xc) / det / sqrt(v * g / (g - 1)) as t, rss, yy as tss from {name}_s s join {name}_v m on {on})"""


def p_sql(t: str) -> str:
    x = f"(abs({t}) / sqrt(2.0::double))"
    u = f"(1 / (1 + 0.5 * {x}))"
    # Coefficients of the approximation, constant first.
    poly = "0.0::double"
    for c in reversed([-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]):
        poly = f"({poly} * u + {c})"
    return f"(select u * exp(-x * x + {poly}) from (select {x} as x, {u} as u))"


STARTS = """starts as (select i::int + 1 as fold_id, (test + to_months((6 * i)::int))::date as test_start from (select max(date) as hi, (min(date) + to_months(36))::date as test from target_daily), range(0, 200) r(i) where (test + to_months((6 * i)::int))::date < hi),
 folds as (select *, coalesce(lead(test_start) over (order by fold_id), date '9999-01-01') as test_end from starts)"""
FOLDS = f"""{STARTS}, train as (select o.*, fold_id from obs o join folds on o.y_date < test_start), {fit_sql('fold_fit', 'train', 'feature_id, window_days, horizon, fold_id')},
 means as (select feature_id, window_days, horizon, fold_id, entity_id, avg(x) as mx, avg(momentum) as mc, avg(y) as my from train group by all),
 pred as (select o.*, m.fold_id, m.my, m.my + r.b * (o.x - m.mx) + r.c * (o.momentum - m.mc) as p from obs o join folds f on o.date >= f.test_start and o.date < f.test_end join means m on m.fold_id = f.fold_id and m.feature_id = o.feature_id and m.window_days = o.window_days and m.horizon = o.horizon and m.entity_id = o.entity_id
  join fold_fit r on r.fold_id = f.fold_id and r.feature_id = o.feature_id and r.window_days = o.window_days and r.horizon = o.horizon),
 outside as (select feature_id, window_days, horizon, fold_id, sum((y - p) ** 2) as sse, sum((y - my) ** 2) as sst, covar_pop(y, p) * count(*) as cov, var_pop(p) * count(*) as var from pred group by all),
 fold_rows as (select f.*, 1 - f.rss / f.tss as r2_train, case when sst > 0 then 1 - sse / sst end as r2_oos, sse, sst, cov, var from fold_fit f left join outside o using (feature_id, window_days, horizon, fold_id))"""


@query("v7_fold_coefficients", f"with {PANEL}, {obs_sql('obs', 'panel')}, {FOLDS} select feature_id, window_days, horizon, fold_id, n, round(b * 1e6, 3) as coef_ppm, round(t, 4) as t, round(r2_train, 6) as r2_train, round(r2_oos, 6) as r2_oos from fold_rows")
def v7_folds(s, d):
    rows = hypotheses.hypothesis_rows(panel(s, d), "v", WINDOWS, HORIZONS)
    begins = starts(view(s, d, "target_daily"))
    folds = hypotheses.fold_fits(hypotheses.segmented(rows, begins, ["x", "momentum"], hypotheses.SPEC), len(begins), 2)
    return folds.select(*hypotheses.SPEC, "fold_id", F.col("n").cast("long").alias("n"), F.round(F.col("beta0") * 1e6, 3).alias("coef_ppm"), *[F.round(c, k).alias(c) for c, k in (("t", 4), ("r2_train", 6), ("r2_oos", 6))])


def shuffle_sql(name: str, within: str, runs: range, xs: str) -> str:
    key = "concat_ws('|', '%d', run_id::varchar, feature_id, entity_id, date::varchar)" % SEED
    using = ", ".join(["run_id", *[w.strip() for w in within.split(",")], "place"])
    return f"""{name}_e as (select *, unnest(range({runs.start}, {runs.stop}))::int as run_id from panel), {name}_g as (select run_id, {within}, row_number() over (partition by run_id, {within} order by md5({key}), feature_id, entity_id, date) as place, {xs} from {name}_e),
 {name}_t as (select * exclude ({xs}), row_number() over (partition by run_id, {within} order by feature_id, entity_id, date) as place from {name}_e), {name} as (select * from {name}_t join {name}_g using ({using}))"""


XS = ", ".join(f"v_{n}" for n in WINDOWS)
SCALED = " + ".join(f"{w} * coalesce((r.{c} - lo.{c}) / nullif(hi.{c} - lo.{c}, 0), 0)" for c, w in SCORE_WEIGHTS.items())
RUN_SQL = f"""with {PANEL}, {obs_sql('obs', 'panel')}, {FOLDS}, {fit_sql('whole', 'obs', 'feature_id, window_days, horizon')},
 placed as (select o.*, n_regionkey as region from obs o join nation on entity_id = 'COUNTRY_' || n_nationkey), {fit_sql('slice_fit', 'placed', 'feature_id, window_days, horizon, region')},
 {shuffle_sql('by_day', 'feature_id, entity_id', range(RUNS // 2), XS)}, {shuffle_sql('by_entity', 'feature_id, date', range(RUNS // 2, RUNS), XS)},
 drawn as (select * from by_day union all by name select * from by_entity), {obs_sql('drawn_obs', 'drawn', 'run_id, ')}, {fit_sql('placebo', 'drawn_obs', 'feature_id, window_days, horizon, run_id')},
 fits as (select *, {p_sql('t')} as p, feature_id as family, case feature_id {' '.join(f"when '{f}' then {v}" for f, v in FEATURES.items())} end as expected_sign, concat_ws('/', feature_id, window_days, horizon) as name from whole),
 ranked as (select *, count(*) over (partition by family) as m, row_number() over (partition by family order by p, name) as k from fits),
 q as (select *, least(1.0, min(p * m / k) over (partition by family order by k desc rows unbounded preceding)) as q from ranked),
 held as (select feature_id, window_days, horizon, count(r2_oos) as folds, count(*) filter (where r2_oos > 0) as folds_positive, avg((sign(r.b) = sign(w.b))::int) as sign_stability, avg(r2_train) as r2_train, 1 - sum(sse) / sum(sst) as r2_oos, sum(cov) / sum(var) as calibration_slope from fold_rows r join whole w using (feature_id, window_days, horizon) group by all),
 passed as (select s.feature_id, s.window_days, s.horizon, count(*) filter (where sign(s.b) = f.expected_sign and {p_sql('s.t')} < 0.1) as slices_passed from slice_fit s join fits f on f.feature_id = s.feature_id and f.window_days = s.window_days and f.horizon = s.horizon group by all),
 beaten as (select p.feature_id, p.window_days, p.horizon, (1 + count(*) filter (where abs(p.t) >= abs(w.t))) / (1.0::double + count(*)) as placebo_p from placebo p join whole w on p.feature_id = w.feature_id and p.window_days = w.window_days and p.horizon = w.horizon group by all),
 runs as (select q.*, sign(b) as sign, 1 - rss / tss as r2_in_sample, held.* exclude (feature_id, window_days, horizon), slices_passed, placebo_p, greatest(r2_oos, 0) as predictive_power, greatest(1 - abs(calibration_slope - 1), 0) as calibration, sign_stability as stability, 2.0 as complexity, n::double as data_cost
  from q left join held using (feature_id, window_days, horizon) left join passed using (feature_id, window_days, horizon) left join beaten using (feature_id, window_days, horizon)),
 lo as (select {', '.join(f'min({c}) as {c}' for c in SCORE_WEIGHTS)} from runs), hi as (select {', '.join(f'max({c}) as {c}' for c in SCORE_WEIGHTS)} from runs),
 judged as (select r.*, {SCALED} as score, case when q < 0.1 and sign = expected_sign and sign_stability >= 0.8 and r2_oos > 0 and placebo_p < 0.05 and slices_passed >= 2 then 'supported' when (q < 0.1 and sign <> expected_sign) or folds_positive = 0 then 'rejected' else 'inconclusive' end as verdict from runs r, lo, hi)
 select feature_id, window_days, horizon, family, expected_sign::double as expected_sign, n, round(b * 1e6, 3) as coef_ppm, round(se * 1e6, 3) as se_ppm, round(t, 4) as t, round(p, 6) as p, round(q, 6) as q, round(r2_in_sample, 6) as r2_in_sample, round(r2_train, 6) as r2_train, round(r2_oos, 6) as r2_oos, round(calibration_slope, 4) as calibration_slope, folds, folds_positive,
  round(sign_stability, 4) as sign_stability, slices_passed, round(placebo_p, 6) as placebo_p, round(score, 4) as score, verdict,
  case when verdict = 'supported' then null when n < 100 then 'data_quality' when n > {DEFAULT.max_days * DEFAULT.max_entities} then 'cost_excessive' when q >= 0.1 then 'no_signal' when sign <> expected_sign then 'wrong_sign' when placebo_p >= 0.05 then 'placebo_fail' when r2_train > 0 and r2_oos <= 0 then 'overfit' when sign_stability < 0.8 then 'unstable' end as reason from judged"""


@query("v15_hypothesis_runs", RUN_SQL)
def v15_runs(s, d):
    targets = view(s, d, "target_daily")
    out = hypotheses.run_hypotheses(panel(s, d), specs(s), starts(targets), "v", WINDOWS, HORIZONS, regions(s, d), RUNS, SEED)
    out = out.withColumns({"coef_ppm": F.round(F.col("coef") * 1e6, 3), "se_ppm": F.round(F.col("se") * 1e6, 3)}).drop("coef", "se")
    return rounded(rounded(out, "t", "calibration_slope", "sign_stability", "score"), "p", "q", "r2_in_sample", "r2_train", "r2_oos", "placebo_p", n=6)


Z = "(v_14 - avg(v_14) over zw) / (stddev_samp(v_14) over zw + 1e-6)"
CHECK_SQL = f"""with {PANEL.replace('panel as (', 'bare as (')}, expo as (select event_date as date, entity_id, sum(pow(ln(1 + num_mentions), 0.5)) as e from both_ends group by 1, 2),
 said as (select t.entity_id, t.date, coalesce(sum(e.e), 0) as exposure_14 from t left join expo e on e.entity_id = t.entity_id and e.date between t.date - 14 and t.date - 1 group by 1, 2),
 zs as (select feature_id, entity_id, date, case when count(*) over zw >= 90 then {Z} end as z from bare window zw as (partition by feature_id, entity_id order by date range between interval 365 days preceding and interval 8 days preceding)),
 panel as (select * exclude (v_14), v_14, v_14 as x_base from bare join said using (entity_id, date) join zs using (feature_id, entity_id, date)),
 forms as (select 'window' as kind, '7' as check_id, v_7 as x, * exclude (x_base) from panel union all by name select 'window' as kind, '14' as check_id, v_14 as x, * exclude (x_base) from panel union all by name select 'window' as kind, '30' as check_id, v_30 as x, * exclude (x_base) from panel
  union all by name select 'form' as kind, 'exposure_adjusted' as check_id, v_14 / (1e-6 + exposure_14) as x, * exclude (x_base) from panel union all by name select 'form' as kind, 'zscore' as check_id, z as x, * exclude (x_base) from panel where z is not null
  union all by name select 'source' as kind, 'local' as check_id, v_local_14 as x, * exclude (x_base) from panel union all by name select 'source' as kind, 'foreign' as check_id, v_foreign_14 as x, * exclude (x_base) from panel
  union all by name select 'extremes' as kind, 'dropped' as check_id, v_14 as x, * exclude (x_base) from panel where abs(z) <= 2
  union all by name select 'without_entity' as kind, o.entity_id as check_id, v_14 as x, p.* exclude (x_base) from panel p join (select distinct entity_id from t) o on o.entity_id <> p.entity_id
  union all by name select 'without_region' as kind, o.r_regionkey::varchar as check_id, v_14 as x, p.* exclude (x_base) from panel p join nation on p.entity_id = 'COUNTRY_' || n_nationkey join region o on o.r_regionkey <> n_regionkey
  union all by name select 'train_window' as kind, fold_id::varchar as check_id, v_14 as x, p.* exclude (x_base) from panel p join starts on p.y_date_{HORIZON} < test_start),
 {shuffle_sql('shuffle_date', 'feature_id, entity_id', range(3), 'x_base')}, {shuffle_sql('shuffle_entity', 'feature_id, date', range(3), 'x_base')}, {shuffle_sql('shuffle_feature', 'entity_id, date', range(3), 'x_base')},
 every as (select kind, check_id, feature_id, entity_id, x, momentum, y_{HORIZON} as y from forms union all {' union all '.join(f"select '{n}', run_id::varchar, feature_id, entity_id, x_base, momentum, y_{HORIZON} from {n}" for n in ('shuffle_date', 'shuffle_entity', 'shuffle_feature'))}),
 good as (select * from every where y is not null and momentum is not null), {fit_sql('fit', 'good', 'feature_id, kind, check_id')}
 select f.feature_id, f.kind, f.check_id, f.n, round(f.b * 1e6, 2) as coef_ppm, round(f.se * 1e6, 2) as se_ppm, round(f.t, 4) as t, round({p_sql('f.t')}, 6) as p, sign(f.b) = sign(a.b) as agrees from fit f join fit a on a.feature_id = f.feature_id and a.kind = '{BASE[0]}' and a.check_id = '{BASE[1]}'"""
CHECK_SQL = CHECK_SQL.replace(" forms as (", f" {STARTS},\n forms as (", 1)


@query("v11_robustness_checks", CHECK_SQL)
def v11_checks(s, d):
    targets = view(s, d, "target_daily")
    from presslens.operators.windows import seasonal_z

    wide = panel(s, d, ("v", "exposure", "v_local", "v_foreign"), WINDOWS, (HORIZON,))
    scored = seasonal_z(wide, ["feature_id", "entity_id"], "v_14", "z")
    z = F.col("z")
    forms = {("window", str(n)): (F.col(f"v_{n}"), None) for n in WINDOWS} | {
        ("form", "exposure_adjusted"): (F.col("v_14") / (DEFAULT.epsilon + F.col("exposure_14")), None), ("form", "zscore"): (z, z.isNotNull()),
        ("source", "local"): (F.col("v_local_14"), None), ("source", "foreign"): (F.col("v_foreign_14"), None), ("extremes", "dropped"): (F.col("v_14"), F.abs(z) <= 2),
    }
    checks = hypotheses.robustness_checks(scored, forms, BASE, HORIZON, regions(s, d), starts(targets), 3, SEED)
    out = checks.withColumns({"coef_ppm": F.round(F.col("coef") * 1e6, 2), "se_ppm": F.round(F.col("se") * 1e6, 2)}).drop("coef", "se")
    return rounded(rounded(out, "t"), "p", n=6)
