"""Queries for expressions, cleaning, joins and aggregates, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslens.config import DEFAULT
from presslens.functions import urls, weights
from presslens.operators import gold, silver
from presslens.plans.catalog import query
from presslens.sources.fixtures import table, view

REL = """case when cameo_root_code = '14' then 'protest_pressure' when quad_class in (1, 2) then 'cooperation' when quad_class = 3 then 'verbal_conflict'
 when quad_class = 4 then 'material_conflict' else 'unknown' end"""
WEIGHT = "pow(ln(1 + num_mentions), 0.5) * pow(1 + num_sources, 0.7) * (1 + 0.6 * abs(goldstein) / 10) * (1 + 0.4 * tanh(-avg_tone / 10))"
EV = f"ev as (select *, {REL} as relation_id, {WEIGHT} as w from world_event)"
BOTH = """both_ends as (select e.*, a.entity_id from ev e, lateral (select e.actor1_entity_id as entity_id union select e.actor2_entity_id) a)"""
EXPO = "expo as (select event_date as date, entity_id, sum(pow(ln(1 + num_mentions), 0.5)) as exposure from both_ends group by 1, 2)"
PAIRS = """pairs as (select event_date as date, actor1_entity_id as src_entity_id, actor2_entity_id as dst_entity_id, relation_id, count(*) as event_count,
 sum(num_mentions)::bigint as mention_count, sum(num_sources)::bigint as source_count, avg(avg_tone) as avg_tone, sum(goldstein) as goldstein_sum, sum(w) as weighted_score
 from ev group by 1, 2, 3, 4)"""
NORM = """left_norm as (select p.*, p.weighted_score / (1e-6 + sqrt(coalesce(a.exposure, 0) * coalesce(b.exposure, 0))) as adj from pairs p
 left join expo a on a.date = p.date and a.entity_id = p.src_entity_id left join expo b on b.date = p.date and b.entity_id = p.dst_entity_id)"""


def events(s, d):
    return silver.map_relation(view(s, d, "world_event"))


def r(c, n=4):
    return F.round(c, n)


def rounded(df, *names, n=4):
    return df.withColumns({c: F.round(c, n) for c in names})


# --- sources of one kind or another that SQL can express
@query("s11_backfill_slice", """select source_event_id, event_date, actor1_entity_id, actor2_entity_id from world_event
 where event_date between date '1995-01-01' and date '1995-12-31' and (actor1_entity_id in ('COUNTRY_1','COUNTRY_2') or actor2_entity_id in ('COUNTRY_1','COUNTRY_2'))""")
def s11(s, d):
    from presslens.sources.raw import backfill_slice

    return backfill_slice(view(s, d, "world_event"), "1995-01-01", "1995-12-31", ["source_event_id", "event_date", "actor1_entity_id", "actor2_entity_id"], ["COUNTRY_1", "COUNTRY_2"])


@query("s6_field_counts", """select page_id % 10 as batch, count(*) as lines, count(*) filter (where fields < 4) as bad, min(fields)::int as fewest, max(fields)::int as most
 from (select page_id, len(string_split(html, '<')) as fields from pages) group by 1""")
def s6(s, d):
    from presslens.sources.raw import with_field_count

    lines = with_field_count(table(s, d, "pages"), "html", "<")
    return lines.groupBy((F.col("page_id") % 10).alias("batch")).agg(F.count("*").alias("lines"), F.count_if(F.col("fields") < 4).alias("bad"), F.min("fields").alias("fewest"), F.max("fields").alias("most"))


@query("s10_new_only", """select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber = 1 and l_returnflag = 'R')""")
def s10(s, d):
    from presslens.sources.raw import new_only

    loaded = table(s, d, "lineitem").filter("l_linenumber = 1 and l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return new_only(table(s, d, "orders"), loaded, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("s15_snapshot", "select 'world_event' as name, min(event_date) as first_date, max(event_date) as last_date, count(*) as row_count from world_event")
def s15(s, d):
    from presslens.sources.raw import snapshot

    return snapshot(view(s, d, "world_event"), "world_event", "event_date").select("name", "first_date", "last_date", "row_count")


@query("s16_retention", "select event_date as date, count(*) as n from world_event where event_date >= date '1998-06-01' - 90 and event_date <= date '1998-06-01' group by 1")
def s16(s, d):
    from presslens.sources.raw import retained

    ev = view(s, d, "world_event").withColumnRenamed("event_date", "date").filter("date <= date'1998-06-01'")
    return retained(ev, "1998-06-01", DEFAULT.retention_days["bronze"]).groupBy("date").agg(F.count("*").alias("n"))


@query("s18_rebuild_dates", "select distinct event_date from world_event where actor1_entity_id in ('COUNTRY_3', 'COUNTRY_8') or actor2_entity_id in ('COUNTRY_3', 'COUNTRY_8')")
def s18(s, d):
    from presslens.sources.raw import rebuild_dates

    changed = table(s, d, "nation").filter("n_nationkey in (3, 8)").select(F.concat(F.lit("COUNTRY_"), "n_nationkey").alias("entity_id"))
    return rebuild_dates(gold.endpoints(view(s, d, "world_event")), changed, "entity_id", "event_date")


@query("s19_timeline_volume", """select date_trunc('day', published_ts)::date as bucket, count(*) as articles, round(count(*) filter (where regexp_matches(lower(text), 'the|uncertain'))::double / count(*), 6) as volume
 from world_article group by 1""")
def s19(s, d):
    from presslens.operators.evidence import timeline_volume

    return timeline_volume(view(s, d, "world_article"), ["the", "uncertain"], "day").select(F.col("bucket").cast("date").alias("bucket"), "articles", r("volume", 6).alias("volume"))


# --- cleaning
@query("p1_to_silver_columns", "select p_partkey, try_cast(p_brand as int) as quad_class, try_cast(p_size::varchar as double) as goldstein from part")
def p1(s, d):
    raw = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("quad_class"), F.col("p_size").cast("string").alias("goldstein"))
    return silver.to_silver_columns(raw)


@query("p2_map_relation", f"with {EV} select relation_id, count(*) as n, sum(num_mentions)::bigint as mentions from ev group by 1")
def p2(s, d):
    return events(s, d).groupBy("relation_id").agg(F.count("*").alias("n"), F.sum("num_mentions").alias("mentions"))


@query("p3_map_relation_fine", """select relation_id, relation_sign, count(*) as n from (select case cameo_root_code when '14' then 'protest_pressure' when '19' then 'material_conflict'
 when '11' then 'verbal_conflict' when '04' then 'cooperation' else 'unknown' end as relation_id, case when cameo_root_code = '04' then -1 else 1 end as relation_sign from world_event) group by 1, 2""")
def p3(s, d):
    return silver.map_relation_fine(view(s, d, "world_event")).groupBy("relation_id", "relation_sign").agg(F.count("*").alias("n"))


THEME_RULES = {"PROMO": "financial_stress", "ECONOMY": "energy_security", "SMALL": "political_uncertainty", "LARGE": "humanitarian_stress", "MEDIUM": "sanction_pressure"}  # stand-ins for themes


@query("p3_map_relation_by_theme", f"with {EV} select coalesce(t.relation, relation_id) as relation_id, count(*) as n from ev left join (values {', '.join(f"('{k}', '{v}')" for k, v in THEME_RULES.items())}) t(theme, relation) on theme_id = theme group by 1")
def p3_theme(s, d):
    return silver.map_relation_by_theme(events(s, d), THEME_RULES).groupBy("relation_id").agg(F.count("*").alias("n"))


@query("p4_parse_date", """select o_orderkey, case when o_orderkey % 10 <> 3 then o_orderdate::date end as d from orders""")
def p4(s, d):
    raw = table(s, d, "orders").withColumn("raw", F.when(F.col("o_orderkey") % 10 == 3, "19971399").otherwise(F.date_format("o_orderdate", "yyyyMMdd")))
    return raw.select("o_orderkey", silver.parse_date(F.col("raw")).alias("d"))


@query("p6_valid_edges", f"with {EV} select relation_id, count(*) as n from ev where relation_id <> 'unknown' and actor1_entity_id is not null and actor2_entity_id is not null group by 1")
def p6(s, d):
    return silver.valid_edges(events(s, d)).groupBy("relation_id").agg(F.count("*").alias("n"))


@query("p7_min_evidence", "select source_event_id, num_sources, num_mentions from world_event where num_sources >= 2 and num_mentions >= 3")
def p7(s, d):
    return silver.min_evidence(view(s, d, "world_event")).select("source_event_id", "num_sources", "num_mentions")


@query("p8_sparsify", f"""with {EV}, {PAIRS}, ranked as (select *, row_number() over (partition by date order by weighted_score desc, src_entity_id, dst_entity_id, relation_id) as n from pairs)
 select date, src_entity_id, dst_entity_id, relation_id, round(weighted_score, 4) as weighted_score from ranked where weighted_score >= 40 or n <= 3 or src_entity_id in ('COUNTRY_4')""")
def p8(s, d):
    universe = table(s, d, "nation").filter("n_nationkey = 4").select(F.concat(F.lit("COUNTRY_"), "n_nationkey").alias("entity_id"))
    kept = silver.sparsify(gold.pair_day_relation(events(s, d)), "date", "weighted_score", 40.0, 3, universe, ["src_entity_id", "dst_entity_id", "relation_id"])
    return kept.select("date", "src_entity_id", "dst_entity_id", "relation_id", r("weighted_score").alias("weighted_score"))


NORM_URL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(source_url)), '^[a-z]+://', ''), '^(www|m)\.', ''), '[?#].*$', ''), '/+$', '')"
KEY = f"sha256(concat_ws('|', strftime(event_date, '%Y-%m-%d'), actor1_entity_id, actor2_entity_id, cameo_root_code, {NORM_URL}))"


@query("p9_dedupe_key", f"select source_event_id, num_mentions, {KEY} as dedupe_key from world_event")
def p9(s, d):
    return silver.with_dedupe_key(view(s, d, "world_event")).select("source_event_id", "num_mentions", "dedupe_key")


@query("p10_urls", r"""select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '^(www|m)\.', ''), '[?#].*$', ''), '/+$', '') as norm,
 regexp_extract(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '^(www|m)\.', ''), '^([^/?#]+)', 1) as domain from pages""")
def p10(s, d):
    return table(s, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("norm"), urls.url_domain(F.col("url")).alias("domain"))


@query("p11_dedupe_events", f"""select {KEY} as dedupe_key, min(source_event_id) as source_event_id, sum(num_mentions)::bigint as num_mentions, max(num_sources) as num_sources, count(distinct source_url) as n_urls, count(*) as copies
 from world_event group by 1""")
def p11(s, d):
    ev = view(s, d, "world_event").select(silver.dedupe_digest().alias("dedupe_key"), "source_event_id", "num_mentions", "num_sources", "source_url")
    return silver.dedupe_events(ev).select(F.lower(F.hex("dedupe_key")).alias("dedupe_key"), "source_event_id", "num_mentions", "num_sources", "n_urls", "copies")


@query("p12_stamp", f"with {EV} select source_event_id, relation_id, 'v1' as feature_version, 'p1' as param_version from ev")
def p12(s, d):
    return silver.stamp(events(s, d).select("source_event_id", "relation_id"), "v1", "p1")


@query("p13_quarantine", """select array_to_string(list_filter([case when event_date < date_added then 'early' end, case when num_mentions > 45 then 'loud' end, case when actor1_entity_id = actor2_entity_id then 'self' end], lambda x: x is not null), '+') as reasons,
 count(*) as n from world_event where event_date < date_added or num_mentions > 45 or actor1_entity_id = actor2_entity_id group by 1""")
def p13(s, d):
    rules = {"early": F.col("event_date") < F.col("date_added"), "loud": F.col("num_mentions") > 45, "self": F.col("actor1_entity_id") == F.col("actor2_entity_id")}
    _, bad = silver.split_quarantine(view(s, d, "world_event"), rules)
    return bad.groupBy(F.array_join("reasons", "+").alias("reasons")).agg(F.count("*").alias("n"))


@query("p14_explode_multi", "select theme, count(*) as n from (select unnest(list_distinct(string_split(p_type, ' '))) as theme from part) where theme <> '' group by 1")
def p14(s, d):
    return silver.explode_multi(table(s, d, "part"), "p_type", "theme", " ").groupBy("theme").agg(F.count("*").alias("n"))


# --- weights
for name, expr, sql in [
    ("e1_mention_damp", lambda: weights.mention_damp(F.col("num_mentions")), "pow(ln(1 + num_mentions), 0.5)"),
    ("e2_mention_cap", lambda: weights.mention_cap(F.col("num_mentions"), 3.0), "least(ln(1 + num_mentions), 3.0)"),
    ("e3_source_factor", lambda: weights.source_factor(F.col("num_sources")), "pow(1 + num_sources, 0.7)"),
    ("e4_tone_risk", lambda: weights.tone_risk(F.col("avg_tone")), "tanh(-avg_tone / 10)"),
    ("e5_goldstein_conflict", lambda: weights.goldstein_conflict(F.col("goldstein")), "greatest(0.0, -goldstein / 10)"),
    ("e5_goldstein_cooperation", lambda: weights.goldstein_cooperation(F.col("goldstein")), "greatest(0.0, goldstein / 10)"),
    ("e5_goldstein_intensity", lambda: weights.goldstein_intensity(F.col("goldstein")), "1 + 0.6 * abs(goldstein) / 10"),
    ("e8_event_weight", lambda: weights.event_weight(), WEIGHT),
    ("e9_tau_weight", lambda: F.exp(-F.col("num_sources") / weights.tau(14.0)), "exp(-num_sources * ln(2) / 14.0)"),
]:
    query(name, f"select source_event_id, round({sql}, 6) + 0.0 as x from world_event")(lambda s, d, e=expr: view(s, d, "world_event").select("source_event_id", (F.round(e(), 6) + 0.0).alias("x")))


@query("e6_source_weight", "select source_event_id, round(case when source_domain = 'src3' then 0.5 when source_domain = 'src7' then 1.5 else 1.0 end, 6) as omega from world_event")
def e6(s, d):
    given = s.createDataFrame([("src3", 0.5), ("src7", 1.5)], "name string, omega double")  # configuration
    ev = view(s, d, "world_event").join(F.broadcast(given), F.col("source_domain") == F.col("name"), "left")
    return ev.select("source_event_id", F.round(F.coalesce("omega", F.lit(1.0)), 6).alias("omega"))


@query("e7_copy_penalty", f"with k as (select source_event_id, {KEY} as dedupe_key from world_event) select source_event_id, round(pow(0.6, row_number() over (partition by dedupe_key order by source_event_id) - 1), 6) as delta from k")
def e7(s, d):
    ranked = silver.copy_ranks(view(s, d, "world_event").select("source_event_id", silver.dedupe_digest().alias("dedupe_key")))
    return ranked.select("source_event_id", F.round(weights.copy_penalty(F.col("copy_rank")), 6).alias("delta"))


@query("e8_full_event_weight", f"""with k as (select *, {KEY} as dedupe_key from world_event) select source_event_id, round({WEIGHT} * case when source_domain = 'src3' then 0.5 when source_domain = 'src7' then 1.5 else 1.0 end
 * pow(0.6, row_number() over (partition by dedupe_key order by source_event_id) - 1), 5) as w from k""")
def e8_full(s, d):
    given = s.createDataFrame([("src3", 0.5), ("src7", 1.5)], "name string, omega double")  # configuration
    ev = view(s, d, "world_event").join(F.broadcast(given), F.col("source_domain") == F.col("name"), "left")
    weighed = ev.select("source_event_id", silver.dedupe_digest().alias("dedupe_key"), weights.sourced_event_weight(F.col("omega")).alias("w"))  # all that goes through the ranges
    return silver.copy_ranks(weighed).select("source_event_id", F.round(F.col("w") * weights.copy_penalty(F.col("copy_rank")), 5).alias("w"))


DIVERSE = """cells as (select event_date, actor1_entity_id, actor2_entity_id, pow(sum(n), 2) / sum(n * n) as diversity from (select event_date, actor1_entity_id, actor2_entity_id, source_domain, count(*) as n from world_event group by all) group by all)"""


@query("e8_diverse_event_weight", f"with {DIVERSE} select source_event_id, round({WEIGHT} * (1 + 0.5 * ln(diversity)), 5) as w from world_event join cells using (event_date, actor1_entity_id, actor2_entity_id)")
def e8_diverse(s, d):
    seen = silver.with_diversity(view(s, d, "world_event"), ["event_date", "actor1_entity_id", "actor2_entity_id"])
    return seen.select("source_event_id", F.round(weights.full_event_weight(F.lit(None).cast("double"), F.lit(1), diversity=F.col("source_diversity")), 5).alias("w"))


@query("p11_source_urls", f"select {KEY} as dedupe_key, source_url, count(*) as copies from world_event group by 1, 2")
def p11_urls(s, d):
    return silver.source_urls(silver.with_dedupe_key(view(s, d, "world_event")))


# --- joins
@query("j1_resolve_entities", """with x as (select source_event_id || '#' || num_mentions || '#' || num_sources || '#' || source_url as rid, replace(actor1_entity_id, 'COUNTRY_', 'NATION_') as alias_text, event_date from world_event),
 m as (select x.rid, x.alias_text, count(distinct a.entity_id) as n, max(a.entity_id) as e, max(a.confidence) as c from x left join entity_alias a on x.alias_text = a.alias_text and x.event_date >= a.valid_from and (a.valid_to is null or x.event_date < a.valid_to) group by 1, 2)
 select rid, case when n = 1 then e end as entity_id, case when n > 1 then 'AMBIGUOUS' when n = 1 then 'RESOLVED' else 'UNKNOWN' end as entity_status, case when n = 1 then c else 0.0 end as confidence from m""")
def j1(s, d):
    ev = view(s, d, "world_event").select(F.concat_ws("#", "source_event_id", "num_mentions", "num_sources", "source_url").alias("rid"), F.replace("actor1_entity_id", F.lit("COUNTRY_"), F.lit("NATION_")).alias("alias_text"), "event_date")
    return silver.resolve_entities(ev.withColumnRenamed("alias_text", "said"), view(s, d, "entity_alias"), "rid", "said", "event_date")


@query("j2_crosswalk", "select source_event_id, source_url, n_name as place from world_event left join nation on actor1_entity_id = 'COUNTRY_' || n_nationkey and n_nationkey < 20")
def j2(s, d):
    codes = table(s, d, "nation").filter("n_nationkey < 20").select(F.concat(F.lit("COUNTRY_"), "n_nationkey").alias("code"), F.col("n_name").alias("place"))
    return silver.crosswalk(view(s, d, "world_event"), codes, "actor1_entity_id", "code", "place").select("source_event_id", "source_url", "place")


@query("j3_link_articles", """select e.event_id, a.article_id, a.entity_id, e.event_type from events e join world_article a on e.event_id // 5 = a.article_id""")
def j3(s, d):
    from presslens.operators.joins import link_articles

    mentions = table(s, d, "events").select("event_id", F.floor(F.col("event_id") / 5).cast("long").alias("article_id"))
    return link_articles(table(s, d, "events").select("event_id", "event_type"), mentions, view(s, d, "world_article").select("article_id", "entity_id"))


@query("j4_pair_exposure", f"""with {EV}, {BOTH}, {EXPO}, {PAIRS} select p.date, p.src_entity_id, p.dst_entity_id, p.relation_id, round(coalesce(a.exposure, 0), 4) as src_exposure, round(coalesce(b.exposure, 0), 4) as dst_exposure
 from pairs p left join expo a on a.date = p.date and a.entity_id = p.src_entity_id left join expo b on b.date = p.date and b.entity_id = p.dst_entity_id""")
def j4(s, d):
    ev = events(s, d)
    both = gold.with_pair_exposure(gold.pair_day_relation(ev), gold.entity_exposure(ev))
    return both.select("date", "src_entity_id", "dst_entity_id", "relation_id", r("src_exposure").alias("src_exposure"), r("dst_exposure").alias("dst_exposure"))


@query("j5_symmetric", f"""with {EV}, {PAIRS} select date, least(src_entity_id, dst_entity_id) as a, greatest(src_entity_id, dst_entity_id) as b, round(sum(weighted_score), 4) as score from pairs group by 1, 2, 3""")
def j5(s, d):
    from presslens.operators.joins import symmetric

    return rounded(symmetric(gold.pair_day_relation(events(s, d)), "weighted_score", "score"), "score")


@query("j6_build_panel", f"""with {EV}, {BOTH}, f as (select event_date as date, entity_id, sum(w) as x from both_ends group by 1, 2), t as (select *, row_number() over (partition by entity_id order by date) as i from target_daily),
 y as (select a.date, a.entity_id, b.px / a.px - 1 as y from t a join t b on a.entity_id = b.entity_id and b.i = a.i + 5)
 select y.date, y.entity_id, round(y.y, 4) as y, round(arg_max(f.x, f.date), 4) as x, max(f.date) as x_date from y join f on f.entity_id = y.entity_id and f.date <= y.date - 1 and f.date >= y.date - 30 group by y.date, y.entity_id, y.y""")
def j6(s, d):
    from presslens.operators.joins import build_panel

    feature = gold.endpoints(events(s, d).withColumn("w", weights.event_weight())).groupBy(F.col("event_date").alias("date"), "entity_id").agg(F.sum("w").alias("x"))
    return rounded(build_panel(feature, view(s, d, "target_daily"), "x", lag_days=1, horizon=5, max_age_days=30), "x", "y")


@query("j7_controls", """with c as (select event_date as date, sum(num_mentions)::bigint as world_mentions from world_event group by 1) select t.date, t.entity_id, t.px, c.world_mentions from target_daily t left join c on t.date = c.date""")
def j7(s, d):
    from presslens.operators.joins import with_controls

    control = view(s, d, "world_event").groupBy(F.col("event_date").alias("date")).agg(F.sum("num_mentions").alias("world_mentions"))
    return with_controls(view(s, d, "target_daily"), [(control, ["date"])])


@query("j8_in_universe", """select date, entity_id, px from target_daily where date between date '1994-01-01' and date '1996-12-31' and entity_id in (select 'COUNTRY_' || n_nationkey from nation where n_regionkey = 1)""")
def j8(s, d):
    from presslens.operators.joins import in_universe

    members = table(s, d, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("COUNTRY_"), "n_nationkey").alias("entity_id"))
    return in_universe(view(s, d, "target_daily"), members, "1994-01-01", "1996-12-31")


DENSE = f"""{EV}, {BOTH}, daily as (select event_date as date, entity_id, sum(w) as v from both_ends group by 1, 2), ends as (select max(date) as hi from daily), firsts as (select entity_id, min(date) as lo from daily group by 1),
 grid as (select entity_id, unnest(generate_series(lo::timestamp, hi::timestamp, interval 1 day))::date as date from firsts, ends), dense as (select g.date, g.entity_id, coalesce(v, 0) as v from grid g left join daily using (date, entity_id))"""


def daily_dense(s, d):
    daily = gold.endpoints(events(s, d).withColumn("w", weights.event_weight())).groupBy(F.col("event_date").alias("date"), "entity_id").agg(F.sum("w").alias("v"))
    return silver.densify(daily, "entity_id", "date", ["v"])


@query("j9_densify", f"with {DENSE} select date, entity_id, round(v, 4) as v from dense")
def j9(s, d):
    return rounded(daily_dense(s, d), "v").select("date", "entity_id", "v")


@query("j10_theme_group", """select g, count(*) as n from (select case when split_part(theme_id, ' ', 1) in ('ECONOMY', 'STANDARD') then 'plain' when split_part(theme_id, ' ', 1) = 'PROMO' then 'push' end as g from world_event) group by 1""")
def j10(s, d):
    groups = s.createDataFrame([("ECONOMY", "plain"), ("STANDARD", "plain"), ("PROMO", "push")], "theme string, g string")
    ev = view(s, d, "world_event").withColumn("theme", F.split_part("theme_id", F.lit(" "), F.lit(1)))
    return ev.join(F.broadcast(groups), "theme", "left").groupBy("g").agg(F.count("*").alias("n"))


@query("j11_evidence_for", f"""with {EV}, cell as (select event_date, actor1_entity_id, relation_id, sum(w) as cell_weight from ev group by 1, 2, 3 having sum(w) > 40)
 select e.event_date, e.actor1_entity_id, e.relation_id, e.source_event_id, e.source_url, round(e.w / cell_weight, 4) as contribution from ev e join cell using (event_date, actor1_entity_id, relation_id)""")
def j11(s, d):
    ev = events(s, d).withColumn("w", weights.event_weight())
    cell = ["event_date", "actor1_entity_id", "relation_id"]
    heavy = ev.groupBy(*cell).agg(F.sum("w").alias("cell_weight")).filter("cell_weight > 40")
    met = ev.join(heavy, cell)
    return met.select(*cell, "source_event_id", "source_url", F.round(F.col("w") / F.col("cell_weight"), 4).alias("contribution"))


@query("j12_assign_folds", """with f as (select i::int as fold_id, date '1995-01-01' + to_months((6 * i)::int) as lo, date '1995-01-01' + to_months((6 * i + 6)::int) as hi from range(0, 4) t(i))
 select fold_id, case when date < lo then 'train' else 'test' end as role, count(*) as n, min(date) as first_date, max(date) as last_date from target_daily, f where date >= date '1992-01-01' and date < hi group by 1, 2""")
def j12(s, d):
    from presslens.operators.validation import assign_folds, walk_forward_folds

    folds = walk_forward_folds(s, "1992-01-01", "1995-01-01", "1997-01-01", 6)
    return assign_folds(view(s, d, "target_daily"), folds).groupBy("fold_id", "role").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("j13_unmapped", "select actor2_entity_id, count(*) as n from world_event where actor2_entity_id not in (select 'COUNTRY_' || n_nationkey from nation where n_nationkey % 3 = 0) group by 1")
def j13(s, d):
    codes = table(s, d, "nation").filter("n_nationkey % 3 = 0").select(F.concat(F.lit("COUNTRY_"), "n_nationkey").alias("code"))
    return silver.unmapped(view(s, d, "world_event"), codes, "actor2_entity_id", "code")


@query("j14_missing_refs", "select p_brand as spec_id, p_type as ref_id from part where p_type not in (select p_type from part where p_size > 45) group by 1, 2")
def j14(s, d):
    from presslens.operators.joins import missing_refs

    part = table(s, d, "part")
    specs = part.groupBy(F.col("p_brand").alias("spec_id")).agg(F.collect_set("p_type").alias("refs"))
    return missing_refs(specs, part.filter("p_size > 45").select(F.col("p_type").alias("id")))


# --- aggregates
@query("a1_pair_day_relation", f"with {EV}, {PAIRS} select date, src_entity_id, dst_entity_id, relation_id, event_count, mention_count, source_count, round(avg_tone, 4) as avg_tone, round(goldstein_sum, 4) as goldstein_sum, round(weighted_score, 4) as weighted_score from pairs")
def a1(s, d):
    return rounded(gold.pair_day_relation(silver.valid_edges(events(s, d))), "avg_tone", "goldstein_sum", "weighted_score")


@query("a2_country_day_state", f"with {EV}, {BOTH} select event_date as date, entity_id, relation_id as state_name, count(*) as raw_count, round(sum(w), 4) as weighted_score, round(1 / sqrt(count(*)), 4) as uncertainty from both_ends group by 1, 2, 3")
def a2(s, d):
    return rounded(gold.country_day_state(events(s, d)), "weighted_score", "uncertainty")


@query("a3_entity_theme_day", f"with {EV}, {BOTH} select event_date as date, entity_id, theme_id, count(*) as article_count, count(distinct source_domain) as source_count, round(avg(avg_tone), 4) as avg_tone from both_ends group by 1, 2, 3")
def a3(s, d):
    return rounded(gold.entity_theme_day(events(s, d)), "avg_tone")


@query("a4_entity_exposure", f"with {EV}, {BOTH}, {EXPO} select date, entity_id, round(exposure, 4) as exposure from expo")
def a4(s, d):
    return rounded(gold.entity_exposure(events(s, d)), "exposure")


@query("a5_global_exposure", "select event_date as date, round(sum(pow(ln(1 + num_mentions), 0.5)), 4) as global_exposure from world_event group by 1")
def a5(s, d):
    return rounded(gold.global_exposure(view(s, d, "world_event")), "global_exposure")


@query("a6_source_diversity", "select actor1_entity_id, round(pow(sum(n), 2.0) / sum(n * n), 4) as source_diversity from (select actor1_entity_id, source_domain, count(*) as n from world_event group by 1, 2) group by 1")
def a6(s, d):
    return rounded(gold.source_diversity(view(s, d, "world_event"), ["actor1_entity_id"]), "source_diversity")


@query("a7_normalize_pair", f"with {EV}, {BOTH}, {EXPO}, {PAIRS}, {NORM} select date, src_entity_id, dst_entity_id, relation_id, round(adj, 4) as exposure_adjusted_score from left_norm")
def a7(s, d):
    ev = events(s, d)
    return rounded(gold.normalize_pair(gold.pair_day_relation(ev), gold.entity_exposure(ev)), "exposure_adjusted_score").select("date", "src_entity_id", "dst_entity_id", "relation_id", "exposure_adjusted_score")


@query("a8_normalize_entity", f"with {EV}, {BOTH}, {EXPO}, t as (select event_date as date, entity_id, theme_id, sum(w) as y from both_ends group by 1, 2, 3) select t.date, t.entity_id, theme_id, round(y / (1e-6 + coalesce(exposure, 0)), 4) as theme_salience from t left join expo using (date, entity_id)")
def a8(s, d):
    ev = events(s, d).withColumn("w", weights.event_weight())
    themes = gold.endpoints(ev).groupBy(F.col("event_date").alias("date"), "entity_id", "theme_id").agg(F.sum("w").alias("y"))
    return rounded(gold.normalize_entity(themes, gold.entity_exposure(ev), "y", "theme_salience"), "theme_salience").select("date", "entity_id", "theme_id", "theme_salience")


@query("a9_theme_share", "with t as (select event_date as date, theme_id, sum(pow(ln(1 + num_mentions), 0.5)) as y from world_event group by 1, 2) select date, theme_id, round(y / (sum(y) over (partition by date) + 1e-6), 4) as share from t")
def a9(s, d):
    return rounded(gold.theme_share(view(s, d, "world_event")), "share")


for grain, sql in [("15 minutes", "time_bucket(interval '15 minutes', ts)"), ("hour", "date_trunc('hour', ts)"), ("day", "date_trunc('day', ts)"), ("week", "date_trunc('week', ts)"), ("month", "date_trunc('month', ts)")]:
    query(f"a10_rollup_{grain.replace(' ', '_')}", f"select epoch(({sql})::timestamp)::bigint as bucket, count(*) as n, round(sum(value), 4) as total from events group by 1")(
        lambda s, d, g=grain: gold.rollup_time(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", g, [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")]).withColumn("bucket", F.unix_timestamp("bucket"))
    )


@query("a11_top_groups", "select cameo_root_code, actor1_entity_id, count(*) as n, round(avg(avg_tone), 4) as tone from world_event group by 1, 2 order by n desc, 1, 2 limit 20")
def a11(s, d):
    groups = view(s, d, "world_event").groupBy("cameo_root_code", "actor1_entity_id").agg(F.count("*").alias("n"), F.round(F.avg("avg_tone"), 4).alias("tone"))
    return groups.orderBy(F.desc("n"), "cameo_root_code", "actor1_entity_id").limit(20)


@query("a12_distinct_sources", "select theme_id, count(distinct source_domain) as sources, count(distinct source_url) as articles from world_event group by 1")
def a12(s, d):
    return view(s, d, "world_event").groupBy("theme_id").agg(F.count_distinct("source_domain").alias("sources"), F.count_distinct("source_url").alias("articles"))


@query("a13_monthly_graph", f"with {EV}, {BOTH}, {EXPO}, {PAIRS}, {NORM} select date_trunc('month', date)::date as month, src_entity_id, dst_entity_id, round(sum(adj), 4) as weight, sum(event_count)::bigint as event_count from left_norm group by 1, 2, 3")
def a13(s, d):
    ev = events(s, d)
    return rounded(gold.monthly_graph(gold.normalize_pair(gold.pair_day_relation(ev), gold.entity_exposure(ev))), "weight")


@query("a14_mapping_rate", """with x as (select row_number() over () as rid, replace(actor1_entity_id, 'COUNTRY_', 'NATION_') as t, event_date from world_event), m as (select rid, count(distinct a.entity_id) as n from x left join entity_alias a on t = alias_text and event_date >= valid_from and (valid_to is null or event_date < valid_to) group by 1)
 select round(avg((n = 1)::int), 6) as resolved_rate, round(avg((n > 1)::int), 6) as ambiguous_rate, round(avg((n = 0)::int), 6) as unknown_rate from m""")
def a14(s, d):
    return rounded(gold.mapping_rate(j1(s, d)), "resolved_rate", "ambiguous_rate", "unknown_rate", n=6)


@query("a15_slice_totals", f"with {EV} select source_domain, relation_id, count(*) as n, sum(num_mentions)::bigint as mentions, grouping(source_domain, relation_id)::int as level from ev group by cube (source_domain, relation_id)")
def a15(s, d):
    return gold.slice_totals(events(s, d), ["source_domain", "relation_id"])


@query("a16_dispersion", f"with {EV}, {PAIRS}, m as (select relation_id, avg(event_count) as mean, var_samp(event_count) as var from pairs group by 1) select relation_id, round(mean, 4) as mean, round(var, 4) as var, round(case when var > mean then mean * mean / (var - mean) end, 4) as kappa from m")
def a16(s, d):
    return rounded(gold.dispersion(gold.pair_day_relation(events(s, d)), "relation_id", "event_count"), "mean", "var", "kappa")


@query("a17_feature_vector", f"""with {EV}, {BOTH}, st as (select event_date as date, entity_id, relation_id as state_name, sum(w) as v from both_ends group by 1, 2, 3)
 select date, entity_id, round(sum(v) filter (where state_name = 'cooperation'), 4) as cooperation, round(sum(v) filter (where state_name = 'protest_pressure'), 4) as protest_pressure from st where state_name in ('cooperation', 'protest_pressure') group by 1, 2""")
def a17(s, d):
    v = gold.feature_vector(gold.country_day_state(events(s, d)), ["cooperation", "protest_pressure"])
    return v.select("date", "entity_id", *[F.round(F.try_element_at("features", F.lit(k)), 4).alias(k) for k in ("cooperation", "protest_pressure")])


@query("a18_tone_profile", "select actor1_entity_id, min(avg_tone) as min_tone, max(avg_tone) as max_tone, round(stddev_samp(avg_tone), 4) as sd_tone, quantile_cont(avg_tone, 0.25) as q25, quantile_cont(avg_tone, 0.5) as q50, quantile_cont(avg_tone, 0.75) as q75 from world_event group by 1")
def a18(s, d):
    return rounded(gold.tone_profile(view(s, d, "world_event"), "actor1_entity_id"), "sd_tone")


# --- Gold tables with all their columns but the time of their making
def windowed_sql(daily, keys, columns, score, more):
    """``columns`` (name: aggregate) over each window of days, the z-score of ``score``, and ``more`` computed from those."""
    by = ", ".join(keys)
    rolled = " union all ".join(
        f"select date, {by}, {days} as window_days, {', '.join(f'{agg} over w as {name}' for name, agg in columns.items())} from {daily} window w as (partition by {by} order by date range between interval {days - 1} days preceding and current row)" for days in DEFAULT.windows
    )
    z = f"case when count({score}) over z >= {PERIODS} then ({score} - avg({score}) over z) / (stddev_samp({score}) over z + {DEFAULT.epsilon}) end"
    return f"""rolled as ({rolled}), scored as (select *, {z} as zscore from rolled window z as (partition by {by}, window_days order by date range between interval {DEFAULT.lookback_days} days preceding and interval {DEFAULT.gap_days} days preceding))
 select date, {by}, window_days, {more}, round(zscore, 3) as zscore, 'f1' as feature_version, 'p1' as param_version from scored"""


PERIODS = 3
PAIR_KEYS = ["src_entity_id", "dst_entity_id", "relation_id"]
PAIR_SUMS = {c: f"sum({c})" for c in ("event_count", "mention_count", "source_count", "goldstein_sum", "weighted_score", "exposure_adjusted_score", "tone_sum")} | {"source_diversity": "avg(source_diversity)"}


@query("a1_gold_pair_day_relation", f"""with {EV}, {BOTH}, {EXPO}, {PAIRS}, {NORM}, shares as (select event_date as date, actor1_entity_id as src_entity_id, actor2_entity_id as dst_entity_id, relation_id, source_domain, count(*) as n from ev group by all),
 diverse as (select date, src_entity_id, dst_entity_id, relation_id, pow(sum(n), 2) / sum(n * n) as source_diversity from shares group by all),
 daily as (select l.* exclude (adj), adj as exposure_adjusted_score, avg_tone * event_count as tone_sum, source_diversity from left_norm l join diverse using (date, src_entity_id, dst_entity_id, relation_id)),
 """ + windowed_sql("daily", PAIR_KEYS, PAIR_SUMS, "exposure_adjusted_score", "event_count::bigint as event_count, mention_count::bigint as mention_count, source_count::bigint as source_count, round(source_diversity, 4) as source_diversity, round(tone_sum / event_count, 4) as avg_tone, round(goldstein_sum, 4) as goldstein_sum, round(weighted_score, 3) as weighted_score, round(exposure_adjusted_score, 4) as exposure_adjusted_score, round(1 / sqrt(event_count), 6) as uncertainty"))  # fmt: skip
def a1_gold(s, d):
    full = gold.gold_pair_day_relation(events(s, d), min_periods=PERIODS).drop("created_at")
    return rounded(rounded(rounded(full, "source_diversity", "avg_tone", "goldstein_sum", "exposure_adjusted_score"), "weighted_score", "zscore", n=3), "uncertainty", n=6)


@query("a2_gold_country_day_state", f"""with {EV}, {BOTH}, {EXPO}, states as (select event_date as date, entity_id, relation_id as state_name, count(*) as raw_count, sum(w) as weighted_score from both_ends group by 1, 2, 3),
 daily as (select s.*, weighted_score / (1e-6 + coalesce(exposure, 0)) as exposure_adjusted_score from states s left join expo using (date, entity_id)),
 """ + windowed_sql("daily", ["entity_id", "state_name"], {c: f"sum({c})" for c in ("raw_count", "weighted_score", "exposure_adjusted_score")}, "exposure_adjusted_score", "raw_count::bigint as raw_count, round(weighted_score, 3) as weighted_score, round(exposure_adjusted_score, 4) as exposure_adjusted_score, round(1 / sqrt(raw_count), 6) as uncertainty"))  # fmt: skip
def a2_gold(s, d):
    full = gold.gold_country_day_state(events(s, d), min_periods=PERIODS).drop("created_at")
    return rounded(rounded(rounded(full, "exposure_adjusted_score"), "weighted_score", "zscore", n=3), "uncertainty", n=6)


@query("a3_gold_entity_theme_day", f"""with {EV}, {BOTH}, themes as (select event_date as date, entity_id, theme_id, count(*) as article_count, count(distinct source_domain) as source_count, avg(avg_tone) as avg_tone from both_ends group by 1, 2, 3),
 daily as (select *, article_count / sum(article_count) over (partition by date, entity_id) as theme_salience, avg_tone * article_count as tone_sum from themes),
 """ + windowed_sql("daily", ["entity_id", "theme_id"], {c: f"sum({c})" for c in ("article_count", "source_count", "tone_sum")} | {"theme_salience": "avg(theme_salience)"}, "theme_salience", "article_count::bigint as article_count, source_count::bigint as source_count, round(tone_sum / article_count, 4) as avg_tone, round(theme_salience, 6) as theme_salience"))  # fmt: skip
def a3_gold(s, d):
    full = gold.gold_entity_theme_day(events(s, d), min_periods=PERIODS).drop("created_at")
    return rounded(rounded(rounded(full, "avg_tone"), "zscore", n=3), "theme_salience", n=6)
