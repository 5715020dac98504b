"""From raw rows to cleaned events: columns, relations, keys, entities, quarantine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.config import DEFAULT, FINE_RULES, RELATIONS, RELATION_RULES, Config
from presslens.functions.urls import normalize_url
from presslens.operators.ranges import running_before

UNKNOWN = "unknown"
SILVER_TYPES = {"quad_class": "int", "num_mentions": "bigint", "num_sources": "bigint", "num_articles": "bigint", "goldstein": "double", "avg_tone": "double"}


def to_silver_columns(raw: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Text columns to their types; what doesn't parse becomes null."""
    types = types or SILVER_TYPES
    return raw.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in raw.columns])


def parse_date(c: Column) -> Column:
    return F.try_to_date(c, "yyyyMMdd")


def relation_of(rules: Sequence[tuple[str, str, tuple]] = RELATION_RULES) -> Column:
    out = None
    for relation, by, values in rules:
        fits = F.col("cameo_root_code" if by == "root" else "quad_class").isin(*values)
        out = F.when(fits, relation) if out is None else out.when(fits, relation)
    return out.otherwise(UNKNOWN)


def map_relation(events: DataFrame) -> DataFrame:
    return events.withColumn("relation_id", relation_of())


def map_relation_fine(events: DataFrame, rules: Sequence[tuple[int, str, str, int]] = FINE_RULES) -> DataFrame:
    """relation_id and relation_sign by root code; of several rules the one of least priority. Rules are configuration: a few rows."""
    table = events.sparkSession.createDataFrame(list(rules), "priority int, root string, relation_id string, relation_sign int")
    first = table.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("priority", "relation_id"))).filter("n = 1").drop("n", "priority")
    joined = events.join(F.broadcast(first), events["cameo_root_code"] == first["root"], "left").drop("root")
    return joined.withColumn("relation_id", F.coalesce("relation_id", F.lit(UNKNOWN))).withColumn("relation_sign", F.coalesce("relation_sign", F.lit(0)))


def map_relation_by_theme(events: DataFrame, rules: Mapping[str, str], theme: str = "theme_id") -> DataFrame:
    """``events`` with the relation that their theme stands for, where ``rules`` (theme: relation) has one; elsewhere the one that they have.

    Only registered relations may be named. Rules are configuration, so they are broadcast.
    """
    if unknown := sorted(set(rules.values()) - set(RELATIONS)):
        raise ValueError(f"unknown relations: {', '.join(unknown)}")
    table = events.sparkSession.createDataFrame(list(rules.items()), "rule_theme string, rule_relation string")
    joined = events.join(F.broadcast(table), F.col(theme) == F.col("rule_theme"), "left")
    return joined.withColumn("relation_id", F.coalesce("rule_relation", "relation_id")).drop("rule_theme", "rule_relation")


def valid_edges(events: DataFrame) -> DataFrame:
    return events.filter(F.col("actor1_entity_id").isNotNull() & F.col("actor2_entity_id").isNotNull() & (F.col("relation_id") != UNKNOWN))


def min_evidence(df: DataFrame, cfg: Config = DEFAULT, sources: str = "num_sources", mentions: str = "num_mentions") -> DataFrame:
    return df.filter((F.col(sources) >= cfg.min_sources) & (F.col(mentions) >= cfg.min_mentions))


def dedupe_key() -> Column:
    parts = [F.date_format("event_date", "yyyy-MM-dd"), F.col("actor1_entity_id"), F.col("actor2_entity_id"), F.col("cameo_root_code"), normalize_url(F.col("source_url"))]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def dedupe_digest() -> Column:
    """The 32 bytes that ``dedupe_key`` shows as 64 digits: what a shuffle of many keys has to carry."""
    return F.unhex(dedupe_key())


def with_dedupe_key(events: DataFrame) -> DataFrame:
    return events.withColumn("dedupe_key", dedupe_key())


def dedupe_events(events: DataFrame) -> DataFrame:
    """One row per dedupe_key, the one with the smallest source_event_id, with its copies folded in.

    ``events`` should have no columns but those wanted: all of them travel with a key. ``min_by`` and the sums combine before the shuffle, by key and address, so a hot key costs a row per
    task and address. Of addresses the row has the first and the number; ``source_urls`` lists all.
    """
    keep = [c for c in events.columns if c not in ("dedupe_key", "num_mentions", "num_sources", "source_url")]
    more = [c for c in keep if c != "source_event_id"]
    kept = [F.min("source_event_id").alias("source_event_id"), *([F.min_by(F.struct(*more), F.col("source_event_id")).alias("row")] if more else [])]
    folded = events.groupBy("dedupe_key").agg(
        *kept, F.sum("num_mentions").alias("num_mentions"), F.max("num_sources").alias("num_sources"),
        F.min("source_url").alias("source_url"), F.count_distinct("source_url").alias("n_urls"), F.count("*").alias("copies"),
    )
    return folded.select("dedupe_key", *[f"row.{c}" if c in more else c for c in keep], "num_mentions", "num_sources", "source_url", "n_urls", "copies")


def source_urls(events: DataFrame) -> DataFrame:
    """(dedupe_key, source_url, copies): every address of a key, a row each, so that no key's list is held in one row."""
    return events.filter("source_url is not null").groupBy("dedupe_key", "source_url").agg(F.count("*").alias("copies"))


def with_diversity(events: DataFrame, cell: Sequence[str], source: str = "source_domain") -> DataFrame:
    """``source_diversity``: the effective number of sources of an event's cell. Null in a cell counts as a value."""
    from presslens.operators.gold import source_diversity

    found = source_diversity(events, list(cell), source)
    found = found.select("source_diversity", *[F.col(c).alias(f"cell_{c}") for c in cell])
    return events.join(found, [F.col(c).eqNullSafe(F.col(f"cell_{c}")) for c in cell]).drop(*[f"cell_{c}" for c in cell])


def copy_ranks(events: DataFrame) -> DataFrame:
    """``copy_rank`` from 1 within each dedupe_key, by source_event_id. A key of many copies is ranked by ranges, in many tasks."""
    return running_before(events, ["source_event_id"], F.lit(1), "copy_rank", ["dedupe_key"]).withColumn("copy_rank", (F.col("copy_rank") + 1).cast("int"))


def stamp(df: DataFrame, feature_version: str, param_version: str) -> DataFrame:
    return df.withColumns({"feature_version": F.lit(feature_version), "param_version": F.lit(param_version)})


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``reasons``: names of the rules (each true for a fault) that a row breaks."""
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()])))


def split_quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    marked = with_reasons(df, rules)
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def explode_multi(df: DataFrame, column: str, out: str, separator: str = ";") -> DataFrame:
    """A row per distinct non-empty value of a separated list."""
    values = F.array_distinct(F.filter(F.transform(F.split(column, separator), lambda x: F.trim(x)), lambda x: x != ""))
    return df.withColumn(out, F.explode(values))


def sparsify(edges: DataFrame, day: str, value: str, threshold: float, k: int, universe: DataFrame | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Edges with events that reach a threshold, are among a day's top k, or touch the universe. Never a dense grid."""
    ranked = edges.withColumn("n", F.row_number().over(Window.partitionBy(day).orderBy(F.desc(value), *ties)))
    keep = (F.col(value) >= threshold) | (F.col("n") <= k)
    if universe is not None:
        inside = F.broadcast(universe.select(F.col("entity_id").alias("u")).distinct())  # a configured list
        ranked = ranked.join(inside, ranked["src_entity_id"] == F.col("u"), "left")
        keep |= F.col("u").isNotNull()
    out = ranked.filter(keep)
    return out.drop("n", "u")


def resolve_entities(df: DataFrame, alias: DataFrame, row_id: str, text: str, day: str) -> DataFrame:
    """(row id, entity_id, entity_status, confidence): the alias that holds on the day, half-open intervals.

    No alias: UNKNOWN, or RAW_ONLY where a code is all there is; several: AMBIGUOUS and no id. An alias
    table is a small registry and is broadcast if Spark finds it small enough; the join is an equi
    join on the text with the interval as residual, and never multiplies rows.
    """
    hit = (df[text] == alias["alias_text"]) & (df[day] >= alias["valid_from"]) & (alias["valid_to"].isNull() | (df[day] < alias["valid_to"]))
    met = df.select(row_id, text, day).join(alias, hit, "left")
    n = F.count_distinct("entity_id")
    found = met.groupBy(row_id).agg(n.alias("n"), F.max("entity_id").alias("e"), F.max("confidence").alias("c"), F.max(text).alias("t"))
    status = F.when(F.col("n") > 1, "AMBIGUOUS").when(F.col("n") == 1, "RESOLVED").when(F.col("t").rlike("^[A-Z]{2,3}$"), "RAW_ONLY").otherwise("UNKNOWN")
    return found.select(row_id, F.when(F.col("n") == 1, F.col("e")).alias("entity_id"), status.alias("entity_status"), F.when(F.col("n") == 1, F.col("c")).otherwise(0.0).alias("confidence"))


def crosswalk(df: DataFrame, codes: DataFrame, column: str, source: str, target: str) -> DataFrame:
    """``target`` of the code table beside ``column``; null where the other system has no such code."""
    return df.join(codes.select(F.col(source).alias("x"), target), F.col(column) == F.col("x"), "left").drop("x")


def unmapped(df: DataFrame, codes: DataFrame, column: str, source: str) -> DataFrame:
    """Values of ``column`` that the code table lacks, and how often they occur."""
    return df.groupBy(column).agg(F.count("*").alias("n")).join(codes.select(F.col(source).alias(column)).distinct(), column, "left_anti")


def densify(df: DataFrame, key: str, day: str, values: Sequence[str]) -> DataFrame:
    """A row for each key and day from the key's first day to the last day of all, values 0 where there was none."""
    last = df.agg(F.max(day).alias("last"))
    spans = df.groupBy(key).agg(F.min(day).alias("first")).join(F.broadcast(last))  # one row
    grid = spans.select(key, F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias(day))
    return grid.join(df.select(key, day, *values), [key, day], "left").fillna(0, list(values))
