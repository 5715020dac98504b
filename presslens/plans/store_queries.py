"""Queries on stored Gold. A layer's store of a data folder is made once per application; every read prunes partitions."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.config import DEFAULT
from presslens.operators import api, gold_store, silver
from presslens.plans.catalog import query
from presslens.plans.scores_queries import STATES
from presslens.plans.tables_queries import EV, PAIRS, rounded
from presslens.scratch import own_dir
from presslens.sources.fixtures import lean_events, view

START, END = "1994-01-01", "1996-12-31"


def folder(s: SparkSession, d: str, kind: str) -> str:
    return f"{own_dir(s)}/{kind}-{hashlib.sha256(d.encode()).hexdigest()[:16]}"


def events(s: SparkSession, d: str) -> DataFrame:
    return silver.map_relation(lean_events(s, d))


def store(s: SparkSession, d: str, layer: gold_store.Layer) -> gold_store.GoldStore:
    """A layer's store over all events of a data folder, made by the first query that asks for it; others need not be made for that."""
    found = gold_store.GoldStore(s, folder(s, d, f"gold-{layer.name}"), [layer])
    if not found.latest():
        found.refresh(events(s, d))
    return found


@query("k1_stored_world_state", f"with {STATES} select date, entity_id, state_name, round(v, 4) as weighted_score from states where entity_id = 'COUNTRY_3' and state_name = 'cooperation' and date between date '{START}' and date '{END}'")
def k1(s, d):
    found = api.get_world_state(store(s, d, gold_store.STATES).read("state_day", START, END), "COUNTRY_3", "cooperation", START, END)
    return rounded(found, "weighted_score").select("date", "entity_id", "state_name", "weighted_score")


@query("k2_stored_relation_timeseries", f"with {EV}, {PAIRS} select date, event_count, mention_count from pairs where src_entity_id = 'COUNTRY_1' and dst_entity_id = 'COUNTRY_2' and relation_id = 'cooperation' and date between date '{START}' and date '{END}'")
def k2(s, d):
    return api.get_relation_timeseries(store(s, d, gold_store.PAIRS).read("pair_day", START, END), "COUNTRY_1", "COUNTRY_2", "cooperation", START, END).select("date", "event_count", "mention_count")


@query("t1_stored_top_pairs", f"""with {EV}, {PAIRS}, w as (select a.date, a.src_entity_id, a.dst_entity_id, a.relation_id, sum(b.event_count)::bigint as event_count, sum(b.mention_count)::bigint as mention_count from pairs a join pairs b on a.src_entity_id = b.src_entity_id and a.dst_entity_id = b.dst_entity_id and a.relation_id = b.relation_id and b.date <= a.date and b.date > a.date - 30
 where a.date between date '1996-03-01' and date '1996-05-31' group by 1, 2, 3, 4) select * from w order by event_count desc, date, src_entity_id, dst_entity_id, relation_id limit 100""")
def t1(s, d):
    found = store(s, d, gold_store.PAIRS).read("pair_window", "1996-03-01", "1996-05-31").filter(F.col("window_days") == 30)
    return found.select("date", "src_entity_id", "dst_entity_id", "relation_id", "event_count", "mention_count").orderBy(F.desc("event_count"), "date", "src_entity_id", "dst_entity_id", "relation_id").limit(100)


TOUCHED = "select distinct event_date as t from world_event where actor1_entity_id = 'COUNTRY_3' and event_date between date '1996-01-01' and date '1996-02-15'"


def touched(ev: DataFrame) -> DataFrame:
    return ev.filter((F.col("actor1_entity_id") == "COUNTRY_3") & api.between("1996-01-01", "1996-02-15", "event_date")).select(F.col("event_date").alias("date")).distinct()


@query("s18_rebuild_frontier", f"""with x as ({TOUCHED}), f as (select t + i::int as date, case when i = 0 then 0 when i < {max(DEFAULT.windows)} then 1 when i >= {DEFAULT.gap_days} then 2 end as kind from x, range(0, {DEFAULT.lookback_days + max(DEFAULT.windows)}) r(i))
 select date::date as date, ['daily', 'window', 'baseline'][min(kind) + 1] as reads from f where kind is not null group by 1""")
def s18_frontier(s, d):
    return gold_store.frontier(touched(view(s, d, "world_event")))


@query("r7_stored_refresh", f"with {EV}, {PAIRS} select date, src_entity_id, dst_entity_id, relation_id, event_count, mention_count, round(weighted_score, 4) as weighted_score from pairs where date between date '1995-06-01' and date '1997-06-30'")
def r7_store(s: SparkSession, d: str) -> DataFrame:
    """Events of one country in some weeks come late: the store is made without them, then refreshed for their dates."""
    found = gold_store.GoldStore(s, folder(s, d, "late"), [gold_store.PAIRS])
    every = events(s, d)
    if not found.latest():
        found.refresh(every.filter(~((F.col("actor1_entity_id") == "COUNTRY_3") & api.between("1996-01-01", "1996-02-15", "event_date"))))
    found.refresh(every, touched(every))
    names = ["date", "src_entity_id", "dst_entity_id", "relation_id", "event_count", "mention_count", "weighted_score"]
    return rounded(found.read("pair_day", "1995-06-01", "1997-06-30").select(*names), "weighted_score")
