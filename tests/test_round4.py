"""What finding 3 of round 4 was about: how often a store's events are made, and what their joins shuffle."""

import datetime as dt

from pyspark.sql import functions as F

from presslens.operators import gold_store
from presslens.plans import load
from presslens.plans.catalog import QUERIES
from presslens.sources import fixtures
from tests.test_gold_store import events
from tests.test_round3 import counted

SF = "/root/testdata/sf0.001"
load()


def test_f3_a_refresh_makes_its_events_once(spark, tmp_path):
    rows = events(spark, n=200)
    df, times = counted(spark, rows)
    store = gold_store.GoldStore(spark, str(tmp_path))
    store.refresh(df)
    assert times.value == 200
    store.refresh(df, rows.filter("event_date < '2019-02-01'").select(F.col("event_date").alias("date")))
    assert times.value == 400 and store.latest() == 2
    assert store.read("pair_day").agg(F.sum("event_count")).first()[0] == 200


def test_f3_a_query_makes_its_own_layer_only(spark, monkeypatch):
    made = []
    monkeypatch.setattr(gold_store.GoldStore, "_write", lambda self, df, name, version, write=gold_store.GoldStore._write: made.append(name) or write(self, df, name, version))
    QUERIES["k1_stored_world_state"](spark, f"{SF}/../sf0.001").count()  # another path, so that no store of other tests is there
    assert made == ["state_day", "state_window"]


def written(spark, path, odd):
    """Tables of the news model; with ``odd`` there are keys that no part, supplier, order or customer has, null ones and parts twice."""
    day = dt.datetime(2001, 1, 1)
    lines = [(i, i % 7, i % 3, i % 7 + 1, float(i % 50), 0.05, 0.02, "R" if i % 2 else "N", "O", day + dt.timedelta(days=i % 5)) for i in range(40)]
    orders, customers, suppliers, parts = [(i, i % 4, day) for i in range(40)], [(i, i) for i in range(4)], [(i, i + 1) for i in range(3)], [(i, f"T{i}") for i in range(7)]
    if odd:
        lines += [(1, None, 1, 1, 1.0, 0.0, 0.0, "N", "F", day), (1, 99, 1, 1, 1.0, 0.0, 0.0, "N", "F", day), (1, 1, None, 1, 1.0, 0.0, 0.0, "N", "F", day), (None, 1, 1, 1, 1.0, None, None, None, None, None)]
        parts += [(3, "again"), (3, "and again"), (5, "again"), (None, "none"), (77, "unused"), (77, "unused")]
        orders, customers, suppliers = orders[:-3] + [(2, 3, day)], customers[:-1], [*suppliers[:-1], (1, 9)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"), "customer": (customers, "c_custkey long, c_nationkey int"),
        "supplier": (suppliers, "s_suppkey long, s_nationkey int"), "part": (parts, "p_partkey long, p_type string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_f3_lean_events_are_those_of_the_view(spark, tmp_path):
    for odd in (False, True):
        d = written(spark, tmp_path / str(odd), odd)
        whole, lean = fixtures.view(spark, d, "world_event").drop("theme_id"), fixtures.lean_events(spark, d)
        assert lean.columns == whole.columns
        assert sorted(map(str, lean.collect())) == sorted(map(str, whole.collect()))
        assert lean.count() == (36 if odd else 40) and (lean.distinct().count() < lean.count()) is odd


def test_f3_lines_are_not_shuffled_for_their_part(spark, tmp_path):
    d = written(spark, tmp_path, False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fixtures.lean_events(spark, d)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 3 and "hashpartitioning(l_partkey" not in plan
