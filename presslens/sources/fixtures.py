"""The tables of the news model, derived by Spark SQL from the tables at hand.

Each view is one statement that Spark and DuckDB both run: ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.scratch import materialize

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels")

WORLD_EVENT = """
select concat(l_orderkey, '-', l_linenumber) as source_event_id,
 cast(l_shipdate as date) as event_date, cast(o_orderdate as date) as date_added,
 concat('COUNTRY_', c_nationkey) as actor1_entity_id, concat('COUNTRY_', s_nationkey) as actor2_entity_id,
 case when l_linenumber = 7 then '14' when l_returnflag = 'R' then '19' when l_returnflag = 'A' then '11' else '04' end as cameo_root_code,
 case when l_returnflag = 'R' then 4 when l_returnflag = 'A' then 3 when l_linestatus = 'F' then 2 else 1 end as quad_class,
 (cast(round(l_discount * 100) as int) - 5) * 2.0e0 as goldstein,
 (cast(round(l_tax * 100) as int) - 4) * 2.5e0 as avg_tone,
 cast(l_quantity as bigint) as num_mentions, 1 + l_partkey % 7 as num_sources,
 p_type as theme_id, concat('src', l_suppkey % 20) as source_domain,
 concat('https://www.src', l_suppkey % 20, '.example.com/a/', l_partkey, '?ref=', l_linenumber) as source_url
from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey
 join {supplier} on l_suppkey = s_suppkey join {part} on l_partkey = p_partkey"""

WORLD_ARTICLE = """
select doc_id as article_id, cast(ts as timestamp) as published_ts, concat('COUNTRY_', user_id % 25) as entity_id,
 source as source_domain, lang as language, text, n_chars, value as tone_raw, event_type as theme_id
from {documents} join {events} on doc_id * 5 = event_id"""

TARGET_DAILY = """
select cast(o_orderdate as date) as date, concat('COUNTRY_', c_nationkey) as entity_id,
 round(avg(o_totalprice), 6) as px from {orders} join {customer} on o_custkey = c_custkey group by 1, 2"""

ENTITY_ALIAS = """
select n_name as alias_text, concat('COUNTRY_', n_nationkey) as entity_id, date '1995-01-01' as valid_from,
 case when n_nationkey % 5 = 0 then date '1998-01-01' end as valid_to, 1.0e0 as confidence from {nation}
union all select n_name, concat('COUNTRY_', n_nationkey, '_V2'), date '1998-01-01', cast(null as date), 0.9e0 from {nation} where n_nationkey % 5 = 0
union all select concat('NATION_', n_nationkey % 3), concat('REGION_', n_regionkey), date '2000-01-01', cast(null as date), 0.5e0 from {nation} where n_nationkey = 7"""

SCORED_LABEL = """
select l.doc_id, quality as y, 1 / (1 + exp(-(n_chars - 3000) / 3000.0e0)) as p from {labels} l join {documents} d on l.doc_id = d.doc_id"""

VIEWS = {"world_event": WORLD_EVENT, "world_article": WORLD_ARTICLE, "target_daily": TARGET_DAILY, "entity_alias": ENTITY_ALIAS, "scored_label": SCORED_LABEL}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if it comes in fewer partitions than there are cores (one small file, one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables of ``sf_dir``."""
    used = [t for t in TABLES if "{" + t + "}" in VIEWS[name]]
    read = {t: table(spark, sf_dir, t) for t in used}
    if "lineitem" in read:  # the one table that drives a view's work
        read["lineitem"] = spread(read["lineitem"])
    return spark.sql(VIEWS[name], **read)


def as_often(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """``rows`` as an inner join with ``others`` repeats and drops them, for a join that reads no other column of ``others``.

    Only keys that ``others`` doesn't hold exactly once change anything. They are found from distinct keys; where there are none,
    as in tables whose references hold, whole rows need not be shuffled by the key.
    """
    held = others.groupBy(F.col(other_key).alias("held_key")).agg(F.count("*").alias("held_times"))
    used = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("held_key")).distinct()
    times = F.coalesce("held_times", F.lit(0).cast("long"))
    odd = materialize(used.join(held, "held_key", "left").select("held_key", times.alias("held_times")).filter("held_times != 1"), "odd-keys")
    known = rows.filter(F.col(key).isNotNull())
    if odd.isEmpty():
        return known
    met = known.join(odd, known[key] == odd["held_key"], "left").drop("held_key")
    return met.withColumn("held_times", F.explode(F.array_repeat(F.lit(1), F.coalesce("held_times", F.lit(1)).cast("int")))).drop("held_times")


def lean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``world_event`` without its themes, for jobs over all events: the same rows by joins that shuffle less.

    Orders meet customers before the lines do, and of parts only the keys are looked at, so that a line is shuffled for its
    order and, where suppliers are too many to be sent to all tasks, for its supplier.
    """
    lines, orders, customer, supplier, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "part"))
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_nationkey")
    lines = as_often(spread(lines), "l_partkey", part, "p_partkey")
    joined = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    columns = WORLD_EVENT.partition("\nfrom ")[0]
    return spark.sql(columns + " from {joined}", joined=joined.withColumn("p_type", F.lit(None).cast("string"))).drop("theme_id")


def ctes(sql: str) -> str:
    """``sql`` for DuckDB with the views that it names put before it."""
    found = [f"{v} as ({text.format(**{t: t for t in TABLES})})" for v, text in VIEWS.items() if v in sql]
    if not found:
        return sql
    body = sql.strip()
    if body.lower().startswith("with "):
        head = "with recursive " if body.lower().startswith("with recursive ") else "with "
        return head + ",\n".join(found) + ",\n" + body[len(head) :]
    return "with " + ",\n".join(found) + "\n" + body
