"""Queries for windows, ordering, sets, indices, text, evidence and graphs, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslens.config import UNCERTAINTY_TERMS
from presslens.functions.weights import event_weight
from presslens.operators import cascades, evidence, gold, graph, graph_series, indices, scans, silver, windows
from presslens.plans.catalog import query
from presslens.plans.tables_queries import BOTH, DENSE, EV, EXPO, NORM, PAIRS, daily_dense, events, r, rounded
from presslens.sources.fixtures import table, view


def pairs_of(s, d):
    return gold.pair_day_relation(events(s, d))


def articles(s, d):
    return view(s, d, "world_article")


# --- windows
for days in (1, 7, 14, 30, 90):
    query(f"w1_rolling_sum_{days}", f"""with {EV}, {PAIRS} select date, src_entity_id, dst_entity_id, relation_id, round(sum(weighted_score) over (partition by src_entity_id, dst_entity_id, relation_id order by date range between interval {days - 1} days preceding and current row), 4) as rolled from pairs""")(
        lambda s, d, n=days: rounded(windows.rolling_sum(pairs_of(s, d), ["src_entity_id", "dst_entity_id", "relation_id"], "weighted_score", n, "rolled"), "rolled").select("date", "src_entity_id", "dst_entity_id", "relation_id", "rolled")
    )


@query("w2_decay_sum", f"""with {EV}, day as (select actor1_entity_id as entity_id, event_date as date, sum(w) as v from ev group by 1, 2)
 select a.entity_id, a.date, round(sum(b.v * exp(-(a.date - b.date) * ln(2) / 14.0)), 4) as decayed from day a join day b on a.entity_id = b.entity_id and b.date <= a.date group by 1, 2""")
def w2(s, d):
    day = events(s, d).withColumn("w", event_weight()).groupBy(F.col("actor1_entity_id").alias("entity_id"), F.col("event_date").alias("date")).agg(F.sum("w").alias("v"))
    return rounded(windows.decay_sum(day, ["entity_id"], "v", "decayed"), "decayed").select("entity_id", "date", "decayed")


Z = "case when count(v) over w >= {n} then (v - avg(v) over w) / (stddev_samp(v) over w + 1e-6) end"
FRAME = "order by date range between interval 365 days preceding and interval 8 days preceding"


@query("w3_seasonal_z", f"with {DENSE} select date, entity_id, round({Z.format(n=90)}, 4) as zscore from dense window w as (partition by entity_id {FRAME})")
def w3(s, d):
    return rounded(windows.seasonal_z(daily_dense(s, d), ["entity_id"], "v"), "zscore").select("date", "entity_id", "zscore")


@query("w4_weekday_z", f"with {DENSE} select date, entity_id, round({Z.format(n=12)}, 4) as zscore from dense window w as (partition by entity_id, isodow(date) {FRAME})")
def w4(s, d):
    return rounded(windows.seasonal_z(daily_dense(s, d), ["entity_id"], "v", by="weekday", min_periods=12), "zscore").select("date", "entity_id", "zscore")


@query("w5_month_z", f"with {DENSE} select date, entity_id, round({Z.format(n=12)}, 4) as zscore from dense window w as (partition by entity_id, month(date) {FRAME})")
def w5(s, d):
    return rounded(windows.seasonal_z(daily_dense(s, d), ["entity_id"], "v", by="month", min_periods=12), "zscore").select("date", "entity_id", "zscore")


@query("w6_winsorize", f"""with {DENSE}, b as (select entity_id, quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.99) as hi from dense where date < date '1996-01-01' group by 1)
 select date, entity_id, round(greatest(least(v, hi), lo), 4) as clipped from dense left join b using (entity_id)""")
def w6(s, d):
    return rounded(windows.winsorize(daily_dense(s, d), ["entity_id"], "v", "clipped", "1996-01-01"), "clipped").select("date", "entity_id", "clipped")


@query("w7_attention_shock", f"""with {DENSE.replace('sum(w) as v', 'sum(pow(ln(1 + num_mentions), 0.5)) as v')} select date, entity_id, round({Z.format(n=90)}, 4) as attention_shock from dense window w as (partition by entity_id {FRAME})""")
def w7(s, d):
    exposure = gold.entity_exposure(view(s, d, "world_event")).withColumnRenamed("exposure", "v")
    return rounded(windows.seasonal_z(silver.densify(exposure, "entity_id", "date", ["v"]), ["entity_id"], "v", "attention_shock"), "attention_shock").select("date", "entity_id", "attention_shock")


@query("w8_lag_matrix", "select date, entity_id, lag(px, 1) over w as px_lag1, lag(px, 2) over w as px_lag2, lag(px, 3) over w as px_lag3 from target_daily window w as (partition by entity_id order by date)")
def w8(s, d):
    return windows.lag_matrix(view(s, d, "target_daily"), ["entity_id"], "px", 3).select("date", "entity_id", "px_lag1", "px_lag2", "px_lag3")


for h in (1, 5, 20):
    query(f"w9_forward_return_{h}", f"select date, entity_id, round(lead(px, {h}) over (partition by entity_id order by date) / px - 1, 6) as y from target_daily")(
        lambda s, d, h=h: windows.forward_return(view(s, d, "target_daily"), ["entity_id"], "px", h, "y").select("date", "entity_id", F.round("y", 6).alias("y"))
    )


@query("w10_topk_per_day", f"with {EV}, {PAIRS} select date, rank::int as rank, src_entity_id, dst_entity_id, relation_id from (select *, row_number() over (partition by date order by mention_count desc, src_entity_id, dst_entity_id, relation_id) as rank from pairs) where rank <= 5")
def w10(s, d):
    best = windows.topk_per_group(pairs_of(s, d), ["date"], [F.desc("mention_count"), "src_entity_id", "dst_entity_id", "relation_id"], 5)
    return best.select("date", "rank", "src_entity_id", "dst_entity_id", "relation_id")


BETA = """joined as (select t.date, t.entity_id, t.px, coalesce(sum(e.num_mentions), 0)::double as x from target_daily t left join world_event e on e.event_date = t.date and e.actor1_entity_id = t.entity_id group by 1, 2, 3),
 betas as (select date, entity_id, case when var_samp(x) over w > 0 then covar_samp(px, x) over w / var_samp(x) over w end as beta from joined window w as (partition by entity_id order by date rows between 59 preceding and current row))"""


def betas(s, d):
    said = view(s, d, "world_event").groupBy(F.col("event_date").alias("date"), F.col("actor1_entity_id").alias("entity_id")).agg(F.sum("num_mentions").cast("double").alias("x"))
    return windows.rolling_beta(view(s, d, "target_daily").join(said, ["date", "entity_id"], "left").fillna(0.0, ["x"]), ["entity_id"], "x", "px", 60)


@query("w11_rolling_beta", f"with {BETA} select date, entity_id, round(beta, 3) as beta from betas")
def w11(s, d):
    return betas(s, d).select("date", "entity_id", r("beta", 3).alias("beta"))


@query("w12_rolling_stability", f"""with {BETA}, m as (select entity_id, sign(avg(beta)) as s from betas group by 1) select entity_id, round(count(*) filter (where sign(beta) = s)::double / nullif(count(beta), 0), 4) as sign_stability from betas join m using (entity_id) group by 1""")
def w12(s, d):
    return rounded(windows.rolling_stability(betas(s, d), ["entity_id"]), "sign_stability")


@query("w13_exp_smooth")
def w13(s, d):
    return rounded(windows.exp_smooth(view(s, d, "target_daily"), ["entity_id"], "px", 0.2), "smoothed")


@query("w13_exp_smooth_series", """with recursive o as (select entity_id, date, px, row_number() over (partition by entity_id order by date) as n from target_daily),
 s as (select entity_id, date, n, px as smoothed from o where n = 1 union all select o.entity_id, o.date, o.n, 0.3 * o.px + 0.7 * s.smoothed from s join o on o.entity_id = s.entity_id and o.n = s.n + 1)
 select entity_id, date, round(smoothed + 1e-7, 3) as smoothed from s""")
def w13_series(s, d):
    found = scans.exp_smooth_series(view(s, d, "target_daily"), ["entity_id"], "px", 0.3)
    return found.select("entity_id", "date", F.round(F.col("smoothed") + 1e-7, 3).alias("smoothed"))


@query("w14_leaderboard", "select p_brand as run_id, score, dense_rank() over (order by score desc)::int as rank, round(percent_rank() over (order by score desc), 6) as percent_rank from (select p_brand, max(p_size) as score from part group by 1)")
def w14(s, d):
    runs = table(s, d, "part").groupBy(F.col("p_brand").alias("run_id")).agg(F.max("p_size").alias("score"))
    return windows.leaderboard(runs, "score").withColumn("percent_rank", F.round("percent_rank", 6))


@query("w15_regime_shift", """with x as (select *, case when count(px) over b = 20 and (var_samp(px) over a + var_samp(px) over b) > 0 then (avg(px) over a - avg(px) over b) / sqrt((var_samp(px) over a + var_samp(px) over b) / 2) end as shift from target_daily
 window a as (partition by entity_id order by date rows between 19 preceding and current row), b as (partition by entity_id order by date rows between 39 preceding and 20 preceding))
 select date, entity_id, round(shift, 4) as shift, coalesce(abs(shift) > 0.8, false) as regime_shift from x""")
def w15(s, d):
    return rounded(windows.regime_shift(view(s, d, "target_daily"), ["entity_id"], "px", 20, 0.8), "shift").select("date", "entity_id", "shift", "regime_shift")


@query("w16_narrative_gaps", """with x as (select event_id, event_type, ts, date_diff('second', lag(date_trunc('second', ts)) over w, date_trunc('second', ts)) as gap from events window w as (partition by event_type order by ts, event_id))
 select event_id, event_type, epoch(date_trunc('second', min(ts) over (partition by event_type)))::bigint as first_seen, gap, sum((coalesce(gap, 0) > 600)::int) over (partition by event_type order by ts, event_id rows unbounded preceding)::bigint as session from x""")
def w16(s, d):
    ev = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.narrative_gaps(ev, ["event_type"], "ts", 600, "event_id").select("event_id", "event_type", F.unix_timestamp("first_seen").alias("first_seen"), "gap", "session")


# --- order, paging, sets
@query("t1_top_relations", f"""with {EV}, {PAIRS}, w as (select *, sum(weighted_score) over (partition by src_entity_id, dst_entity_id, relation_id order by date range between interval 6 days preceding and current row) as week from pairs where relation_id <> 'unknown')
 select date, src_entity_id, dst_entity_id, relation_id, round(week, 4) as week from w order by w.week desc, date, src_entity_id, dst_entity_id, relation_id limit 50""")
def t1(s, d):
    week = windows.rolling_sum(gold.pair_day_relation(silver.valid_edges(events(s, d))), ["src_entity_id", "dst_entity_id", "relation_id"], "weighted_score", 7, "week")
    return week.orderBy(F.desc("week"), "date", "src_entity_id", "dst_entity_id", "relation_id").limit(50).select("date", "src_entity_id", "dst_entity_id", "relation_id", r("week").alias("week"))


@query("t2_page", "select o_orderkey, o_orderdate, o_totalprice from orders where o_orderkey > 500 order by o_orderkey limit 1000")
def t2(s, d):
    from presslens.operators.api import page

    return page(table(s, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderkey", 500, 1000)


TOP_EV = f"""with {EV}, c as (select source_event_id, source_url, actor1_entity_id, relation_id, event_date, w / sum(w) over (partition by actor1_entity_id, relation_id, event_date) as contribution from ev)"""


def contributed(s, d):
    return evidence.contributions(events(s, d).withColumn("w", event_weight()), ["actor1_entity_id", "relation_id", "event_date"], "w")


@query("t3_top_evidence", TOP_EV + """, k as (select * exclude (contribution), round(contribution, 4) as contribution from c), o as (select *, row_number() over (partition by actor1_entity_id, relation_id, event_date order by contribution desc, source_event_id, source_url) as rank from k)
 select event_date, actor1_entity_id, relation_id, rank::int as rank, source_event_id, contribution from o where rank <= 3""")
def t3(s, d):
    best = windows.topk_per_group(rounded(contributed(s, d), "contribution"), ["actor1_entity_id", "relation_id", "event_date"], [F.desc("contribution"), "source_event_id", "source_url"], 3)
    return best.select("event_date", "actor1_entity_id", "relation_id", "rank", "source_event_id", "contribution")


@query("u1_union_layers", "select o_orderkey as id, o_orderstatus as status, null::varchar as flag from orders union all select l_orderkey, null, l_returnflag from lineitem where l_linenumber = 1")
def u1(s, d):
    from presslens.sources.raw import union_layers

    old = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return union_layers([old, table(s, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("flag"))])


@query("u2_endpoints", f"with {EV}, {BOTH} select entity_id, count(*) as n from both_ends group by 1")
def u2(s, d):
    return gold.endpoints(events(s, d)).groupBy("entity_id").agg(F.count("*").alias("n"))


@query("u3_diff_snapshots", """with a as (select o_orderkey, o_orderstatus from orders where o_orderkey % 7 <> 0), b as (select o_orderkey, o_orderstatus from orders where o_orderkey % 5 <> 0)
 select 'added' as change, count(*) as n from (select * from b except all select * from a) union all select 'removed', count(*) from (select * from a except all select * from b) union all select 'kept', count(*) from (select * from a intersect all select * from b)""")
def u3(s, d):
    from presslens.sources.layers import diff_snapshots

    orders = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return diff_snapshots(orders.filter("o_orderkey % 7 <> 0"), orders.filter("o_orderkey % 5 <> 0"))


# --- indices
STATES = f"{EV}, {BOTH}, states as (select event_date as date, entity_id, relation_id as state_name, sum(w) as v from both_ends group by 1, 2, 3)"
RISK = {"protest_pressure": 1.0, "material_conflict": 0.8, "verbal_conflict": 0.5, "cooperation": -0.3}


def states_of(s, d):
    return gold.country_day_state(events(s, d))


@query("i1_risk_pressure", f"with {STATES} select date, entity_id, round(" + " + ".join(f"{w} * coalesce(sum(v) filter (where state_name = '{k}'), 0)" for k, w in RISK.items()) + ", 4) as risk_pressure from states group by 1, 2")
def i1(s, d):
    return rounded(indices.risk_pressure(states_of(s, d), RISK, "weighted_score"), "risk_pressure")


@query("i2_financial_stress", f"""with {EV}, kept as (select * from ev where num_sources >= 2 and num_mentions >= 3 and (relation_id = 'material_conflict' or theme_id like 'PROMO%')), day as (select actor1_entity_id as entity_id, event_date as date, sum(w) as v from kept group by 1, 2)
 select date, entity_id, round(sum(v) over (partition by entity_id order by date range between interval 6 days preceding and current row), 4) as s7, round(sum(v) over (partition by entity_id order by date range between interval 13 days preceding and current row), 4) as s14, round(sum(v) over (partition by entity_id order by date range between interval 29 days preceding and current row), 4) as s30 from day""")
def i2(s, d):
    kept = silver.min_evidence(events(s, d)).filter((F.col("relation_id") == "material_conflict") | F.col("theme_id").startswith("PROMO")).withColumn("w", event_weight())
    day = kept.groupBy(F.col("event_date").alias("date"), F.col("actor1_entity_id").alias("entity_id")).agg(F.sum("w").alias("v"))
    for n in (7, 14, 30):
        day = windows.rolling_sum(day, ["entity_id"], "v", n, f"s{n}")
    return rounded(day, "s7", "s14", "s30").drop("v")


HAWK = "case split_part(theme_id, ' ', 1) when 'PROMO' then 'hawkish' when 'ECONOMY' then 'dovish' when 'STANDARD' then 'inflation_concern' when 'SMALL' then 'growth_concern' when 'LARGE' then 'currency_defense' end"


@query("i3_policy_hawkishness", f"with {EV} select event_date as date, actor1_entity_id as entity_id, round(sum(case g when 'hawkish' then w when 'inflation_concern' then w when 'currency_defense' then w when 'dovish' then -w when 'growth_concern' then -w else 0 end), 4) as policy_hawkishness from (select *, {HAWK} as g from ev) group by 1, 2")
def i3(s, d):
    groups = {"PROMO": "hawkish", "ECONOMY": "dovish", "STANDARD": "inflation_concern", "SMALL": "growth_concern", "LARGE": "currency_defense"}
    names = F.broadcast(s.createDataFrame(list(groups.items()), "head string, theme_group string"))
    ev = events(s, d).withColumn("weight", event_weight()).withColumn("head", F.split_part("theme_id", F.lit(" "), F.lit(1))).join(names, "head", "left")
    return rounded(indices.policy_hawkishness(ev.select(F.col("event_date").alias("date"), F.col("actor1_entity_id").alias("entity_id"), "theme_group", "weight")), "policy_hawkishness")


@query("i4_policy_uncertainty", f"select published_ts::date as date, entity_id, sum(len(regexp_extract_all(lower(text), '{'|'.join(UNCERTAINTY_TERMS)}')))::bigint as terms, count(*) as articles from world_article group by 1, 2")
def i4(s, d):
    return indices.policy_uncertainty_counts(articles(s, d))


def z_sql(value, keys, periods):
    over = f"over (partition by {keys} order by date range between interval 365 days preceding and interval 8 days preceding)"
    return f"case when count({value}) {over} >= {periods} then ({value} - avg({value}) {over}) / (stddev_samp({value}) {over} + 1e-6) end"


@query("i4_policy_uncertainty_z", f"""with c as (select published_ts::date as date, entity_id, sum(len(regexp_extract_all(lower(text), '{'|'.join(UNCERTAINTY_TERMS)}')))::double / count(*) as rate from world_article group by 1, 2) select date, entity_id, round(rate, 6) as rate, round({z_sql("rate", "entity_id", 2)}, 3) as policy_uncertainty from c""")
def i4z(s, d):
    found = indices.policy_uncertainty(articles(s, d), min_periods=2)
    return found.select("date", "entity_id", F.round("rate", 6).alias("rate"), F.round("policy_uncertainty", 3).alias("policy_uncertainty"))


NARRATIVES = {"financial_stress": "PROMO", "capital_flight": "ECONOMY", "currency_crisis": "LARGE", "debt_stress": "SMALL"}  # stand-ins for groups of themes
RISK_Z = {"financial_stress": 1.0, "social_unrest": 1.0, "external_conflict": 1.0, "negative_tone": 1.0, "capital_flight": 1.0, "currency_crisis": 0.5, "debt_stress": 0.5}


@query("i1_risk_pressure_z", f"""with {EV}, {BOTH}, {EXPO}, parts as (select event_date as date, entity_id, unnest([{{'n': 'social_unrest', 'v': case when relation_id in ('protest_pressure', 'repression_pressure') then w end}},
 {{'n': 'external_conflict', 'v': case when actor1_entity_id <> actor2_entity_id and relation_id in ('verbal_conflict', 'material_conflict', 'sanction_pressure', 'trade_tension') then w end}}, {{'n': 'negative_tone', 'v': w * greatest(0.0, tanh(-avg_tone / 10))}}, {", ".join(f"{{'n': '{n}', 'v': case when split_part(theme_id, ' ', 1) = '{h}' then w end}}" for n, h in NARRATIVES.items())}]) as e from both_ends),
 daily as (select date, entity_id, e.n as state_name, sum(e.v) as value from parts where e.v is not null group by 1, 2, 3), adj as (select d.*, value / (1e-6 + coalesce(exposure, 0)) as a from daily d left join expo using (date, entity_id)),
 z as (select date, entity_id, state_name, {z_sql("a", "entity_id, state_name", 30)} as z from adj) select date, entity_id, round(sum(coalesce(z, 0) * case state_name {" ".join(f"when '{n}' then {w}" for n, w in RISK_Z.items())} end), 3) as risk_pressure from z group by 1, 2""")
def i1z(s, d):
    ev = events(s, d).withColumn("theme_id", F.split_part("theme_id", F.lit(" "), F.lit(1)))
    parts = indices.risk_components(ev, {n: [h] for n, h in NARRATIVES.items()}, min_periods=30)
    return rounded(indices.risk_pressure(parts, RISK_Z), "risk_pressure", n=3)


@query("i5_social_unrest", f"with {STATES} select date, entity_id, round(sum(v), 4) as social_unrest from states where state_name in ('protest_pressure', 'repression_pressure') group by 1, 2")
def i5(s, d):
    return rounded(indices.component(states_of(s, d), ["protest_pressure", "repression_pressure"], out="social_unrest"), "social_unrest")


@query("i6_external_conflict", f"""with {EV}, {PAIRS} select date, entity_id, round(sum(weighted_score), 4) as external_conflict from (select date, unnest([src_entity_id, dst_entity_id]) as entity_id, weighted_score from pairs where src_entity_id <> dst_entity_id and relation_id in ('verbal_conflict', 'material_conflict', 'sanction_pressure', 'trade_tension')) group by 1, 2""")
def i6(s, d):
    return rounded(indices.external_conflict(pairs_of(s, d)), "external_conflict")


@query("i7_bilateral_tension", f"with {EV}, {PAIRS} select date, src_entity_id, dst_entity_id, round(sum(case when relation_id in ('verbal_conflict', 'material_conflict', 'sanction_pressure', 'trade_tension') then weighted_score when relation_id = 'cooperation' then -weighted_score else 0 end), 4) as tension from pairs group by 1, 2, 3")
def i7(s, d):
    return rounded(indices.bilateral_tension(pairs_of(s, d)), "tension")


@query("i9_negative_tone", f"with {EV}, {BOTH} select event_date as date, entity_id, round(sum(w * greatest(0.0, tanh(-avg_tone / 10))), 4) as negative_tone from both_ends group by 1, 2")
def i9(s, d):
    both = gold.endpoints(events(s, d).withColumn("w", event_weight()))
    toned = both.withColumn("negative", F.col("w") * F.greatest(F.lit(0.0), F.tanh(-F.col("avg_tone") / 10)))
    return toned.groupBy(F.col("event_date").alias("date"), "entity_id").agg(r(F.sum("negative")).alias("negative_tone"))


# --- text and evidence
@query("x1_sentences", r"select article_id, count(*) as n from (select article_id, trim(unnest(regexp_split_to_array(text, '[.!?\n]+')), ' ') as x from world_article) where x <> '' group by 1")
def x1(s, d):
    return evidence.sentences(articles(s, d)).groupBy("article_id").agg(F.count("*").alias("n"))


def alt(terms):
    return "|".join(terms)


STANCE_TERMS = {"hawk": ["the and", "of the"], "dove": ["le de", "and the"], "flip": ["not", "nicht", "unlikely", "is"]}
X2 = f"(regexp_matches(lower(x), '{alt(STANCE_TERMS['hawk'])}')::int - regexp_matches(lower(x), '{alt(STANCE_TERMS['dove'])}')::int)"


@query("x2_stance_score", rf"select article_id, sum(case when regexp_matches(lower(x), '\b(?:{alt(STANCE_TERMS['flip'])})\b') then -{X2} else {X2} end)::bigint as stance from (select article_id, trim(unnest(regexp_split_to_array(text, '[.!?\n]+')), ' ') as x from world_article) where x <> '' group by 1")
def x2(s, d):
    said = evidence.sentences(articles(s, d))
    return said.groupBy("article_id").agg(F.sum(evidence.stance(F.col("sentence"), STANCE_TERMS["hawk"], STANCE_TERMS["dove"], STANCE_TERMS["flip"])).cast("long").alias("stance"))


@query("x3_lexicon_count", "select published_ts::date as date, language, sum(len(regexp_extract_all(lower(text), 'the|and|of')))::bigint as terms from world_article group by 1, 2")
def x3(s, d):
    return articles(s, d).groupBy(F.to_date("published_ts").alias("date"), "language").agg(F.sum(evidence.lexicon_count(F.col("text"), ["the", "and", "of"])).alias("terms"))


@query("x4_copy_groups", r"with h as (select article_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ')) as content_hash from world_article) select content_hash, article_id, min(article_id) over (partition by content_hash) as first_id, count(*) over (partition by content_hash) as copies from h")
def x4(s, d):
    return evidence.copy_groups(articles(s, d))


@query("x4_near_copies")
def x4n(s, d):
    return evidence.near_copies(articles(s, d))


DAILY = """a as (select published_ts::date as date, count(*) as n from world_article where language = 'en' group by 1), b as (select published_ts::date as date, count(*) as n from world_article where language <> 'en' group by 1)"""


@query("x5_lead_lag", f"with {DAILY} select l.lag::int as lag, count(*) as n, round(corr(a.n, b.n), 4) as corr from a, (select unnest(range(-3, 4)) as lag) l, b where b.date = a.date + l.lag::int group by 1")
def x5(s, d):
    daily = articles(s, d).groupBy(F.to_date("published_ts").alias("date"), (F.col("language") == "en").alias("local")).agg(F.count("*").alias("n"))
    return rounded(evidence.lead_lag(daily.filter("local").drop("local"), daily.filter("not local").drop("local"), 3), "corr")


@query("x6_diffusion", """with f as (select theme_id, source_domain, min(published_ts) as t from world_article group by 1, 2) select theme_id, source_domain, epoch(date_trunc('second', t))::bigint as first_seen, row_number() over (partition by theme_id order by t, source_domain)::int as k,
 (epoch(date_trunc('second', t)) - epoch(date_trunc('second', min(t) over (partition by theme_id))))::bigint as delay from f""")
def x6(s, d):
    return evidence.diffusion(articles(s, d), "theme_id", "source_domain").withColumn("first_seen", F.unix_timestamp("first_seen"))


CARRIED = r"""copied as (select sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ')) as group_id, source_domain as source, epoch(date_trunc('second', min(published_ts)))::bigint as first_at from world_article group by 1, 2),
 started as (select *, min(first_at) over (partition by group_id) as root_at, count(*) over (partition by group_id) as sources from copied),
 known as (select * from started join (select source, 1 + count(*) filter (where first_at = root_at and sources > 1) as influence from started group by 1) using (source))"""


def chosen_sql(name, rows, keys):
    """Of all earlier carriers of a group the likeliest, by looking at every pair."""
    same = " and ".join(f"a.{k} = b.{k}" for k in keys)
    return f"""{name} as (select a.*, b.source as parent, b.first_at as parent_at from {rows} a left join {rows} b on {same} and b.first_at < a.first_at
 qualify row_number() over (partition by {", ".join(f"a.{k}" for k in keys)}, a.source order by ln(b.influence) + (b.first_at - b.root_at) / (24 * 3600 / ln(2)) desc, b.source) = 1)"""


TREE = f"""{CARRIED}, {chosen_sql("linked", "known", ["group_id"])},
 tree as (select *, 0 as depth, source as root from linked where parent is null union all select l.*, t.depth + 1, t.root from linked l join tree t on l.group_id = t.group_id and l.parent = t.source)"""


def carried(s, d):
    copies = evidence.copy_groups(articles(s, d)).select("article_id", F.col("content_hash").alias("group_id"))
    return cascades.carriers(articles(s, d), copies)


@query("x6_copy_chains", f"with recursive {TREE} select group_id, source, first_at, parent, first_at - parent_at as delay, root, depth from tree")
def x6_chains(s, d):
    return cascades.propagation(carried(s, d)).select("group_id", "source", "first_at", "parent", "delay", "root", "depth")


@query("x6_cascades", f"""with recursive {TREE}, placed as (select *, row_number() over (partition by group_id order by first_at, source) as k from tree)
 select group_id, count(*) as sources, max(depth) as max_depth, round(avg(depth), 6) as mean_depth, max(first_at - root_at) filter (where k = 2) as delay_2, max(first_at - root_at) filter (where k = 3) as delay_3, max(first_at - root_at) filter (where k = 5) as delay_5 from placed group by 1""")
def x6_cascades(s, d):
    return rounded(cascades.summaries(cascades.propagation(carried(s, d)), (2, 3, 5)), "mean_depth", n=6)


@query("x5_source_leads", f"""with {CARRIED}, many as (select * from known where sources > 1), {chosen_sql("linked", "many", ["group_id"])}, times as (select *, row_number() over (partition by group_id order by first_at, source) as place from many),
 dealt as (select r.i::int as round, m.group_id, m.source, m.influence, row_number() over (partition by r.i, m.group_id order by md5(concat_ws(':', 'leads', r.i, m.group_id, m.source)), m.source) as place from many m, range(1, 20) r(i)),
 chance as (select e.round, e.group_id, e.source, e.influence, t.first_at, t.root_at from dealt e join times t using (group_id, place)), {chosen_sql("by_chance", "chance", ["round", "group_id"])},
 n as (select parent as leader, source as follower, count(*) as n from linked where parent is not null group by 1, 2), c as (select round, parent as leader, source as follower, count(*) as m from by_chance where parent is not null group by 1, 2, 3)
 select n.leader, n.follower, n.n, coalesce(any_value(b.n), 0) as n_back, count(c.round) as at_least, (1 + count(c.round))::double / 20 as p from n left join n b on b.leader = n.follower and b.follower = n.leader left join c on c.leader = n.leader and c.follower = n.follower and c.m >= n.n group by 1, 2, 3""")
def x5_leads(s, d):
    return cascades.leads(carried(s, d))


@query("x7_amplification", """with c as (select theme_id, language, count(*) as n from world_article group by 1, 2) select theme_id, language, n, round((n / sum(n) over (partition by theme_id)) / (sum(n) over (partition by language) / sum(n) over ()), 4) as ratio from c""")
def x7(s, d):
    return rounded(evidence.amplification(articles(s, d), "theme_id", "language"), "ratio")


@query("x8_search_evidence", r"""with d as (select article_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from world_article where published_ts >= timestamp '2024-01-01' and published_ts < timestamp '2024-01-10'),
 c as (select article_id, len(w) as n, len(list_filter(w, lambda x: x = 'license')) as t0, len(list_filter(w, lambda x: x = 'the')) as t1 from d),
 s as (select count(*) as docs, avg(n) as avg_len, count(*) filter (where t0 > 0) as d0, count(*) filter (where t1 > 0) as d1 from c)
 select article_id, round(ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / avg_len)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / avg_len)), 6) as score from c, s where t0 > 0 or t1 > 0 order by score desc, article_id limit 25""")
def x8(s, d):
    return evidence.search_evidence(articles(s, d), ["license", "the"], "2024-01-01", "2024-01-10", 25)


@query("x8_search_fields", r"""with d as (select article_id, list_filter(regexp_split_to_array(lower(concat_ws(' ', text, theme_id, source_domain)), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from world_article where published_ts >= timestamp '2024-01-01' and published_ts < timestamp '2024-01-10'),
 c as (select article_id, len(w) as n, len(list_filter(w, lambda x: x = 'purchase')) as t0, len(list_filter(w, lambda x: x = 'the')) as t1 from d),
 s as (select count(*) as docs, avg(n) as avg_len, count(*) filter (where t0 > 0) as d0, count(*) filter (where t1 > 0) as d1 from c)
 select article_id, round(ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / avg_len)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / avg_len)), 6) as score from c, s where t0 > 0 or t1 > 0 order by score desc, article_id limit 25""")
def x8_fields(s, d):
    return evidence.search_evidence(articles(s, d), ["purchase", "the"], "2024-01-01", "2024-01-10", 25, fields=("text", "theme_id", "source_domain"))


@query("x9_similar_articles", """with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 20 = 0), x as (select query_id, vec_id, list_cosine_similarity(q::double[], embedding::double[]) as score from q, embeddings where vec_id <> query_id)
 select query_id, vec_id, round(score, 6) as score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from x) where rank <= 10""")
def x9(s, d):
    vectors = table(s, d, "embeddings").select("vec_id", "embedding")
    return evidence.similar_articles(vectors, vectors.filter("vec_id % 20 = 0"), 10).withColumn("score", F.round("score", 6))


@query("x10_contributions", TOP_EV + " select source_event_id, source_url, event_date, actor1_entity_id, relation_id, round(contribution, 4) as contribution from c")
def x10(s, d):
    return rounded(contributed(s, d), "contribution").select("source_event_id", "source_url", "event_date", "actor1_entity_id", "relation_id", "contribution")


@query("x11_build_evidence", r"""with t as (select event_id // 5 as article_id, array_to_string(list_sort(list_distinct(list(event_type))), ';') as tags from events group by 1)
 select a.article_id, source_domain, language, coalesce(tags, '') as tags, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ')) as content_hash, substring(text, 1, 200) as snippet from world_article a left join t on a.article_id = t.article_id""")
def x11(s, d):
    tags = table(s, d, "events").select(F.floor(F.col("event_id") / 5).cast("long").alias("article_id"), F.col("event_type").alias("tag"))
    return evidence.build_evidence(articles(s, d), tags)


# --- graph
def monthly(s, d):
    ev = events(s, d)
    return gold.monthly_graph(gold.normalize_pair(gold.pair_day_relation(ev), gold.entity_exposure(ev)))


GRAPH = f"with {EV}, {BOTH}, {EXPO}, {PAIRS}, {NORM}, g as (select src_entity_id, dst_entity_id, sum(adj) as weight from left_norm group by 1, 2)"


@query("g1_strength", GRAPH + ", e as (select src_entity_id as node, weight as o, 0 as i from g union all select dst_entity_id, 0, weight from g) select node, round(sum(o), 4) as out_strength, round(sum(i), 4) as in_strength from e group by 1")
def g1(s, d):
    return rounded(graph.strength(whole_graph(s, d)), "out_strength", "in_strength")


def whole_graph(s, d):
    return monthly(s, d).groupBy("src_entity_id", "dst_entity_id").agg(F.sum("weight").alias("weight"))


@query("g1_pagerank")
def g1p(s, d):
    return rounded(graph.pagerank(whole_graph(s, d)), "rank", n=6)


@query("g2_communities")
def g2(s, d):
    return graph.communities(whole_graph(s, d))


@query("g3_tension_clusters")
def g3(s, d):
    total = indices.bilateral_tension(pairs_of(s, d)).groupBy("src_entity_id", "dst_entity_id").agg(F.sum("tension").alias("tension"))
    return graph.tension_clusters(total, 100.0)


MONTHLY = f"with recursive {EV}, {BOTH}, {EXPO}, {PAIRS}, {NORM}, g as (select date_trunc('month', date)::date as month, src_entity_id as a, dst_entity_id as b, sum(adj) as w from left_norm group by 1, 2, 3)"


@query("g1_monthly_pagerank", MONTHLY + """, links as (select month, a, b, w / sum(w) over (partition by month, a) as p from g where w > 0), nodes as (select month, a as node from links union select month, b from links),
 n as (select month, count(*) as n from nodes group by 1), r(i, month, node, rank) as (select 0, month, node, 1.0::double / n from nodes join n using (month)
  union all select i + 1, month, node, 0.15 / n + 0.85 * (got + (1 - sum(got) over (partition by month)) / n) from (select r.i, r.month, x.node, n.n, coalesce(sum(s.rank * l.p), 0) as got
   from (select distinct i, month from r where i < 60) r join nodes x on x.month = r.month join n on n.month = r.month left join links l on l.month = r.month and l.b = x.node left join r s on s.month = r.month and s.node = l.a group by 1, 2, 3, 4))
 select month, node, round(rank, 6) as rank from r where i = 60""")
def g1_monthly(s, d):
    return rounded(graph_series.pagerank_series(monthly(s, d)), "rank", n=6)


@query("g2_monthly_communities")
def g2_monthly(s, d):
    found = graph_series.communities_series(monthly(s, d))
    return rounded(graph_series.lineages(found, "add_months(month, -1)"), "modularity", n=6)


HOT = 22.0


@query("g3_monthly_clusters", f"""with recursive {EV}, {PAIRS}, tense as (select date_trunc('month', date)::date as month, src_entity_id as a, dst_entity_id as b, sum(case relation_id when 'cooperation' then -1.0 when 'verbal_conflict' then 1.0 when 'material_conflict' then 1.0 else 0.0 end * weighted_score) as t from pairs group by 1, 2, 3),
 hot as (select month, a, b from tense where t >= {HOT} and a <> b union select month, b, a from tense where t >= {HOT} and a <> b), reach as (select month, a, b from hot union select r.month, r.a, h.b from reach r join hot h on h.month = r.month and h.a = r.b),
 c as (select month, a as node, min(least(a, b)) as label from reach group by 1, 2), sh as (select x.month, x.label, y.month as was, y.label as old, count(*) as n from c x join c y on y.node = x.node and y.month = (x.month - to_months(1))::date group by 1, 2, 3, 4),
 mu as (select * from (select *, row_number() over (partition by month, label order by n desc, old) as u, row_number() over (partition by was, old order by n desc, label) as d from sh) where u = 1 and d = 1),
 chain as (select c.month, c.label, c.month as rm, c.label as rl, 0 as age from (select distinct month, label from c) c left join mu using (month, label) where mu.old is null union all select m.month, m.label, h.rm, h.rl, h.age + 1 from chain h join mu m on m.was = h.month and m.old = h.label)
 select c.month, c.node, c.label, rm::varchar || '|' || rl as lineage, age::bigint as age from c join chain using (month, label)""")
def g3_monthly(s, d):
    tension = indices.bilateral_tension(pairs_of(s, d)).groupBy(F.trunc("date", "month").alias("month"), "src_entity_id", "dst_entity_id").agg(F.sum("tension").alias("tension"))
    return graph_series.lineages(graph_series.clusters_series(tension, HOT), "add_months(month, -1)")


@query("g4_narrative_similarity", """with s as (select actor1_entity_id as e, theme_id, sum(num_mentions)::double as v from world_event group by 1, 2), n as (select e, sqrt(sum(v * v)) as norm from s group by 1)
 select x.e as a, y.e as b, round(sum(x.v * y.v) / (nx.norm * ny.norm), 4) as similarity from s x join s y on x.theme_id = y.theme_id and x.e < y.e join n nx on nx.e = x.e join n ny on ny.e = y.e group by x.e, y.e, nx.norm, ny.norm""")
def g4(s, d):
    themes = view(s, d, "world_event").select(F.col("actor1_entity_id").alias("entity_id"), "theme_id", F.col("num_mentions").cast("double").alias("value"))
    return rounded(graph.narrative_similarity(themes), "similarity")
