"""Aggregates: the Gold tables and what normalises them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.config import DEFAULT, Config
from presslens.functions.weights import event_weight, mention_damp
from presslens.operators.windows import by_day, in_blocks, own_rows, scored_in_blocks

EDGE = ("event_date", "actor1_entity_id", "actor2_entity_id", "relation_id")


def endpoints(events: DataFrame) -> DataFrame:
    """A row for each event and each of its distinct actors, as ``entity_id``."""
    return events.withColumn("entity_id", F.explode(F.array_distinct(F.array("actor1_entity_id", "actor2_entity_id"))))


def pair_day_relation(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return events.groupBy(F.col("event_date").alias("date"), F.col("actor1_entity_id").alias("src_entity_id"), F.col("actor2_entity_id").alias("dst_entity_id"), "relation_id").agg(
        F.count("*").alias("event_count"), F.sum("num_mentions").alias("mention_count"), F.sum("num_sources").alias("source_count"),
        F.avg("avg_tone").alias("avg_tone"), F.sum("goldstein").alias("goldstein_sum"), F.sum(event_weight(cfg)).alias("weighted_score"),
    )


def country_day_state(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    both = endpoints(events.withColumn("w", event_weight(cfg)))
    return both.groupBy(F.col("event_date").alias("date"), "entity_id", F.col("relation_id").alias("state_name")).agg(
        F.count("*").alias("raw_count"), F.sum("w").alias("weighted_score"), (1 / F.sqrt(F.count("*"))).alias("uncertainty")
    )


def entity_theme_day(events: DataFrame) -> DataFrame:
    return endpoints(events).groupBy(F.col("event_date").alias("date"), "entity_id", "theme_id").agg(
        F.count("*").alias("article_count"), F.count_distinct("source_domain").alias("source_count"), F.avg("avg_tone").alias("avg_tone")
    )


def entity_exposure(events: DataFrame) -> DataFrame:
    return endpoints(events).groupBy(F.col("event_date").alias("date"), "entity_id").agg(F.sum(mention_damp(F.col("num_mentions"))).alias("exposure"))


def global_exposure(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("event_date").alias("date")).agg(F.sum(mention_damp(F.col("num_mentions"))).alias("global_exposure"))


def source_diversity(df: DataFrame, keys: Sequence[str | Column], source: str = "source_domain") -> DataFrame:
    """The effective number of sources, 1 over the sum of squared shares."""
    names = [k if isinstance(k, str) else "" for k in keys]
    counts = df.groupBy(*keys, source).agg(F.count("*").alias("n"))
    return counts.groupBy(*names).agg((F.pow(F.sum("n"), F.lit(2.0)) / F.sum(F.col("n") * F.col("n"))).alias("source_diversity"))


def with_pair_exposure(pairs: DataFrame, exposure: DataFrame) -> DataFrame:
    """Exposure of both ends of a pair on its day, 0 if there is none."""
    src = exposure.select(F.col("date"), F.col("entity_id").alias("src_entity_id"), F.col("exposure").alias("src_exposure"))
    dst = exposure.select(F.col("date"), F.col("entity_id").alias("dst_entity_id"), F.col("exposure").alias("dst_exposure"))
    return pairs.join(src, ["date", "src_entity_id"], "left").join(dst, ["date", "dst_entity_id"], "left").fillna(0.0, ["src_exposure", "dst_exposure"])


def normalize_pair(pairs: DataFrame, exposure: DataFrame, value: str = "weighted_score", cfg: Config = DEFAULT) -> DataFrame:
    return with_pair_exposure(pairs, exposure).withColumn("exposure_adjusted_score", F.col(value) / (cfg.epsilon + F.sqrt(F.col("src_exposure") * F.col("dst_exposure"))))


def normalize_entity(df: DataFrame, exposure: DataFrame, value: str, out: str = "exposure_adjusted_score", cfg: Config = DEFAULT) -> DataFrame:
    return df.join(exposure, ["date", "entity_id"], "left").withColumn(out, F.col(value) / (cfg.epsilon + F.coalesce("exposure", F.lit(0.0)))).drop("exposure")


def theme_share(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    themes = events.groupBy(F.col("event_date").alias("date"), "theme_id").agg(F.sum(mention_damp(F.col("num_mentions"))).alias("y"))
    return themes.join(global_exposure(events), "date").select("date", "theme_id", (F.col("y") / (F.col("global_exposure") + cfg.epsilon)).alias("share"))


def rollup_time(df: DataFrame, ts: str, grain: str, aggs: Sequence[Column]) -> DataFrame:
    """grain: '15 minutes', 'hour', 'day', 'week' (from Monday) or 'month'."""
    bucket = F.window(ts, grain)["start"] if " " in grain else F.date_trunc(grain, ts)
    return df.groupBy(bucket.alias("bucket")).agg(*aggs)


def monthly_graph(pairs: DataFrame, value: str = "exposure_adjusted_score") -> DataFrame:
    return pairs.groupBy(F.trunc("date", "month").alias("month"), "src_entity_id", "dst_entity_id").agg(F.sum(value).alias("weight"), F.sum("event_count").alias("event_count"))


def mapping_rate(df: DataFrame, status: str = "entity_status") -> DataFrame:
    share = lambda s: F.avg((F.col(status) == s).cast("double"))
    return df.agg(share("RESOLVED").alias("resolved_rate"), share("AMBIGUOUS").alias("ambiguous_rate"), share("UNKNOWN").alias("unknown_rate"))


def slice_totals(events: DataFrame, by: Sequence[str]) -> DataFrame:
    return events.cube(*by).agg(F.count("*").alias("n"), F.sum("num_mentions").alias("mentions"), F.grouping_id().cast("int").alias("level"))


def dispersion(df: DataFrame, by: str, value: str) -> DataFrame:
    """Moment estimate of a negative binomial's size; null where the variance doesn't exceed the mean."""
    m = df.groupBy(by).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    return m.select(by, "mean", "var", F.when(F.col("var") > F.col("mean"), F.col("mean") * F.col("mean") / (F.col("var") - F.col("mean"))).alias("kappa"))


def feature_vector(states: DataFrame, names: Sequence[str], value: str = "weighted_score") -> DataFrame:
    """A map of features per date and entity."""
    return states.filter(F.col("state_name").isin(*names)).groupBy("date", "entity_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("state_name", value)))).alias("features"))


def tone_profile(events: DataFrame, by: str) -> DataFrame:
    return events.groupBy(by).agg(
        F.min("avg_tone").alias("min_tone"), F.max("avg_tone").alias("max_tone"), F.stddev_samp("avg_tone").alias("sd_tone"),
        F.percentile("avg_tone", 0.25).alias("q25"), F.percentile("avg_tone", 0.5).alias("q50"), F.percentile("avg_tone", 0.75).alias("q75"),
    )


VERSIONS = {"feature_version": "f1", "param_version": "p1"}


def windowed(daily: DataFrame, keys: Sequence[str], sums: Sequence[str], means: Sequence[str], score: str, cfg: Config = DEFAULT, min_periods: int | None = None) -> DataFrame:
    """``daily`` once for each of ``cfg.windows``: sums and means over its days up to a row's date, and the seasonal z-score of ``score`` among those sums.

    Blocks of days reach back as far as the sums in a score's frame do, so that all windows come out of one sorted pass over the
    daily rows; a row is told apart by window only at its end.
    """
    rolled = {c: F.sum(c) for c in sums} | {c: F.avg(c) for c in means}
    w = by_day([*keys, "w_block"])
    blocks = in_blocks(daily, "date", cfg.lookback_days + max(cfg.windows) - 1)
    wide = blocks.withColumns({f"{c}_{days}": agg.over(w.rangeBetween(-(days - 1), 0)) for days in cfg.windows for c, agg in rolled.items()})
    scored = own_rows(scored_in_blocks(wide, keys, {f"zscore_{days}": f"{score}_{days}" for days in cfg.windows}, cfg, min_periods=min_periods))
    each = [F.struct(F.lit(days).alias("window_days"), *[F.col(f"{c}_{days}").alias(c) for c in (*rolled, "zscore")]) for days in cfg.windows]
    long = scored.withColumn("w_row", F.explode(F.array(*each)))
    out = long.select(*[F.col(f"w_row.{c}").alias(c) if c in rolled else c for c in daily.columns], "w_row.window_days", "w_row.zscore")
    return out.withColumns({k: F.lit(v) for k, v in VERSIONS.items()} | {"created_at": F.current_timestamp()})


PAIR, STATE = ("src_entity_id", "dst_entity_id", "relation_id"), ("entity_id", "state_name")


def pair_daily(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """What the windows of pairs add up: a row per date with events, pair and relation. A date needs only its own events."""
    daily = normalize_pair(pair_day_relation(events, cfg), entity_exposure(events), cfg=cfg).withColumn("tone_sum", F.col("avg_tone") * F.col("event_count")).drop("src_exposure", "dst_exposure")
    named = events.select(F.col("event_date").alias("date"), F.col("actor1_entity_id").alias("src_entity_id"), F.col("actor2_entity_id").alias("dst_entity_id"), "relation_id", "source_domain")
    return daily.join(source_diversity(named, ["date", *PAIR]), ["date", *PAIR])


def pair_windows(daily: DataFrame, cfg: Config = DEFAULT, min_periods: int | None = None) -> DataFrame:
    sums = ["event_count", "mention_count", "source_count", "goldstein_sum", "weighted_score", "exposure_adjusted_score", "tone_sum"]
    out = windowed(daily, PAIR, sums, ["source_diversity"], "exposure_adjusted_score", cfg, min_periods)
    return out.withColumns({"avg_tone": F.col("tone_sum") / F.col("event_count"), "uncertainty": 1 / F.sqrt("event_count")}).drop("tone_sum")


def gold_pair_day_relation(events: DataFrame, cfg: Config = DEFAULT, min_periods: int | None = None) -> DataFrame:
    """The Gold table of directed pairs: a row per date with events, pair, relation and window."""
    return pair_windows(pair_daily(events, cfg), cfg, min_periods)


def state_daily(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return normalize_entity(country_day_state(events, cfg).drop("uncertainty"), entity_exposure(events), "weighted_score", cfg=cfg)


def state_windows(daily: DataFrame, cfg: Config = DEFAULT, min_periods: int | None = None) -> DataFrame:
    out = windowed(daily, STATE, ["raw_count", "weighted_score", "exposure_adjusted_score"], [], "exposure_adjusted_score", cfg, min_periods)
    return out.withColumn("uncertainty", 1 / F.sqrt("raw_count"))


def gold_country_day_state(events: DataFrame, cfg: Config = DEFAULT, min_periods: int | None = None) -> DataFrame:
    """The Gold table of country states: a row per date with events, entity, state and window."""
    return state_windows(state_daily(events, cfg), cfg, min_periods)


def gold_entity_theme_day(events: DataFrame, cfg: Config = DEFAULT, min_periods: int | None = None) -> DataFrame:
    """The Gold table of themes: a row per date with articles, entity, theme and window. Salience is the theme's share of the entity's articles of that day."""
    daily = entity_theme_day(events)
    whole = daily.groupBy("date", "entity_id").agg(F.sum("article_count").alias("all_articles"))
    shared = daily.join(whole, ["date", "entity_id"]).withColumn("theme_salience", F.col("article_count") / F.col("all_articles")).withColumn("tone_sum", F.col("avg_tone") * F.col("article_count")).drop("all_articles")
    out = windowed(shared, ["entity_id", "theme_id"], ["article_count", "source_count", "tone_sum"], ["theme_salience"], "theme_salience", cfg, min_periods)
    return out.withColumn("avg_tone", F.col("tone_sum") / F.col("article_count")).drop("tone_sum")
