"""Queries for sources and sinks: raw lines and layers are written from the given tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from presslens.config import RELATION_RULES
from presslens.plans.catalog import query
from presslens.scratch import own_dir
from presslens.sources import raw
from presslens.sources.fixtures import table, view
from presslens.streaming import streams


def folder(s, name):
    return f"{own_dir(s)}/{name}-{uuid.uuid4().hex}"


def fields(n, known):
    """A line of ``n`` tab-separated fields, empty but for those of ``known``, a dict of columns by place."""
    return F.concat_ws("\t", *[F.coalesce(known[i].cast("string"), F.lit("")) if i in known else F.lit("") for i in range(n)])


def event_lines(s, d):
    """World events as raw lines of 61 fields; those of each order's seventh line item lack the last one."""
    at = {name: i for i, name in enumerate(raw.EVENT_COLUMNS)}
    columns = {"GlobalEventID": "source_event_id", "EventRootCode": "cameo_root_code", "QuadClass": "quad_class", "GoldsteinScale": "goldstein", "NumMentions": "num_mentions", "NumSources": "num_sources", "AvgTone": "avg_tone"}
    known = {at[k]: F.col(v) for k, v in columns.items()} | {at["SQLDATE"]: F.date_format("event_date", "yyyyMMdd")}
    short = F.col("source_event_id").endswith("-7")
    return view(s, d, "world_event").select(F.when(short, fields(60, known)).otherwise(fields(61, known)).alias("value"))


def written_lines(s, lines, name):
    at = folder(s, name)
    lines.write.text(at)
    return at


@query("s1_parse_file_list", "select case doc_id % 4 when 0 then 'export' when 1 then 'mentions' else 'gkg' end as kind, count(*) as n, count(distinct doc_id) as urls from documents where doc_id % 4 <> 3 group by 1")
def s1(s, d):
    kind = F.element_at(F.array(*map(F.lit, ["export.CSV", "mentions.CSV", "gkg.csv", "other"])), (F.col("doc_id") % 4 + 1).cast("int"))
    lines = table(s, d, "documents").select(F.concat_ws(" ", F.col("n_chars").cast("string"), F.lit("abc"), F.concat(F.lit("http://host.example/"), F.col("doc_id").cast("string"), F.lit("."), kind, F.lit(".zip"))).alias("value"))
    return raw.parse_file_list(lines).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query("s2_raw_events", "select cameo_root_code as root_code, strftime(event_date, '%Y%m') as month, count(*) as n, sum(num_mentions)::bigint as mentions, round(sum(goldstein), 4) as goldstein from world_event where source_event_id not like '%-7' group by 1, 2")
def s2(s, d):
    events = raw.read_raw_events(s, written_lines(s, event_lines(s, d), "raw-events"))
    total = F.sum(F.col("NumMentions").cast("long")).alias("mentions")
    return events.groupBy(F.col("EventRootCode").alias("root_code"), F.substring("SQLDATE", 1, 6).alias("month")).agg(F.count("*").alias("n"), total, F.round(F.sum(F.col("GoldsteinScale").cast("double")), 4).alias("goldstein"))


@query("s3_raw_mentions", "select event_type as kind, count(*) as n, sum(event_id)::bigint as ids from events group by 1")
def s3(s, d):
    lines = table(s, d, "events").select(fields(10, {0: F.col("event_id"), 2: F.col("event_type"), 9: F.col("value")}).alias("value"))
    return raw.read_raw_mentions(s, written_lines(s, lines, "raw-mentions")).groupBy(F.col("m2").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col("m0").cast("long")).alias("ids"))


@query("s4_raw_gkg", "select source, lang, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1, 2")
def s4(s, d):
    lines = table(s, d, "documents").select(fields(20, {0: F.col("doc_id"), 3: F.col("source"), 7: F.col("lang"), 19: F.col("n_chars")}).alias("value"))
    return raw.read_raw_gkg(s, written_lines(s, lines, "raw-gkg")).groupBy(F.col("g3").alias("source"), F.col("g7").alias("lang")).agg(F.count("*").alias("n"), F.sum(F.col("g19").cast("long")).alias("chars"))


@query("s7_write_layer", "select strftime(event_date, '%Y-%m') as month, count(*) as n, sum(num_mentions)::bigint as mentions from world_event group by 1")
def s7(s, d):
    at = folder(s, "layer")
    raw.write_layer(view(s, d, "world_event").select(F.date_format("event_date", "yyyy-MM").alias("month"), "source_event_id", "num_mentions"), at, "month")
    return s.read.schema("source_event_id string, num_mentions long, month string").parquet(at).groupBy("month").agg(F.count("*").alias("n"), F.sum("num_mentions").alias("mentions"))


@query("s8_validate_field_count", "select count(*) filter (where source_event_id not like '%-7') as good, count(*) filter (where source_event_id like '%-7') as bad from world_event")
def s8(s, d):
    good, bad = raw.validate_field_count(event_lines(s, d), "export", 0.5)
    return good.select(F.lit(1).alias("ok")).unionByName(bad.select(F.lit(0).alias("ok"))).agg(F.count_if(F.col("ok") == 1).alias("good"), F.count_if(F.col("ok") == 0).alias("bad"))


@query("s9_lineage_and_manifest", "select count(*) as lines, count(distinct doc_id || '|' || lang) as hashes, count(*)::bigint as manifest_rows, true as every_file_has_a_checksum from documents")
def s9(s, d):
    at = written_lines(s, table(s, d, "documents").select(F.concat_ws("|", F.col("doc_id").cast("string"), "lang").alias("value")), "lineage")
    lined = raw.with_lineage(s.read.text(at), "batch")
    manifest = raw.build_manifest(s, lined, f"{at}/*.txt").agg(F.sum("rows").alias("manifest_rows"), F.bool_and(F.length("sha256") == 64).alias("every_file_has_a_checksum"))
    return lined.agg(F.count("*").alias("lines"), F.count_distinct("raw_line_hash").alias("hashes")).join(manifest)  # one row each


@query("s12_views_and_union", "select source, count(*) as n, count(*) filter (where doc_id % 2 = 0) as marked from documents group by 1")
def s12(s, d):
    docs, at = table(s, d, "documents").select("doc_id", "source"), folder(s, "views")
    name = f"layer_{uuid.uuid4().hex}"
    raw.union_layers([docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0").withColumn("mark", F.lit(1))]).write.parquet(f"{at}/{name}")
    raw.register_views(s, at, [name])
    return s.table(name).groupBy("source").agg(F.count("*").alias("n"), F.count("mark").alias("marked"))


@query("s14_snippets", "select published_ts::date as date, count(*) as n from world_article group by 1")
def s14(s, d):
    at = folder(s, "snippets")
    rows = view(s, d, "world_article").select(F.to_date("published_ts").alias("date"), "article_id", F.substring("text", 1, 80).alias("snippet"))
    raw.write_snippets(rows, at)
    return s.read.schema("article_id long, snippet string, date date").json(at).groupBy("date").agg(F.count("*").alias("n"))


@query("s17_lookup", f"select relation_id, count(*) as n from world_event join (values {', '.join(f'({int(code)}, {chr(39)}{relation}{chr(39)})' for relation, by, codes in RELATION_RULES if by == 'quad' for code in codes)}) t(quad, relation_id) on quad_class = quad group by 1")
def s17(s, d):
    rules = raw.lookup(s, [(code, relation) for relation, by, codes in RELATION_RULES if by == "quad" for code in codes], "quad int, relation_id string")
    return view(s, d, "world_event").join(rules, F.col("quad_class") == F.col("quad")).groupBy("relation_id").agg(F.count("*").alias("n"))


# --- streams that end in files
def event_stream(s, d):
    return streams.stream_files(s, f"{d}/events.parquet*", table(s, d, "events").schema)


@query("r1_stream_files", "select event_type, count(*) as n, sum(event_id)::bigint as ids from events group by 1")
def r1(s, d):
    at = folder(s, "stream-files")
    for _ in range(2):  # what was read once is not read again
        streams.run_to_files(event_stream(s, d), f"{at}/out", f"{at}/checkpoint")
    return s.read.schema(table(s, d, "events").schema).parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("r7_upsert_dates", "select ts::date as date, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def r7(s, d):
    at = folder(s, "upsert")
    dated = event_stream(s, d).withColumn("date", F.to_date("ts")).select("date", "event_type", "value")
    streams.upsert_dates(dated, at, f"{at}/checkpoint", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")])
    return s.read.schema("event_type string, n long, total double, date date").parquet(f"{at}/gold").select("date", "event_type", "n", F.round("total", 4).alias("total"))
