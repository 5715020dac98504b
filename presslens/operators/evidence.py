"""Text, propagation and evidence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.config import DOVISH, FLIPS, HAWKISH
from presslens.operators.alike import similar_groups


def any_of(terms: Sequence[str], whole_words: bool = False) -> str:
    import re

    joined = "|".join(re.escape(t) if not t.isalpha() else t for t in terms)
    return rf"\b(?:{joined})\b" if whole_words else joined


def sentences(df: DataFrame, text: str = "text", out: str = "sentence") -> DataFrame:
    return df.withColumn(out, F.explode(F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: x != "")))


def stance(sentence: Column, hawkish: Sequence[str] = HAWKISH, dovish: Sequence[str] = DOVISH, flips: Sequence[str] = FLIPS) -> Column:
    """+1 hawkish, -1 dovish, 0 neither or both; a word of negation or reversal in the sentence turns it round."""
    low = F.lower(sentence)
    side = low.rlike(any_of(hawkish)).cast("int") - low.rlike(any_of(dovish)).cast("int")
    return F.when(low.rlike(any_of(flips, True)), -side).otherwise(side)


def lexicon_count(text: Column, terms: Sequence[str]) -> Column:
    return F.regexp_count(F.lower(text), F.lit(any_of(terms))).cast("long")


def content_hash(text: Column) -> Column:
    """Of the text lower-cased, with runs of white space as one space."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256)


def copy_groups(articles: DataFrame, key: str = "article_id") -> DataFrame:
    """Exact copies after normalisation: the group's smallest id and size beside each. Only hashes are shuffled."""
    hashed = articles.select(key, content_hash(F.col("text")).alias("content_hash"))
    groups = hashed.groupBy("content_hash").agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))
    return hashed.join(groups, "content_hash")


def near_copies(articles: DataFrame, threshold: float = 0.8, key: str = "article_id") -> DataFrame:
    """(key, group_id): articles linked by a Jaccard similarity of ``threshold`` or more of their five-word shingles.

    Every such link counts (``alike.py``); a text of the same words but for case and white space is an exact copy.
    """
    return similar_groups(articles.select(F.col(key).alias("key"), F.lower("text").cast("binary").alias("text")), threshold).withColumnRenamed("key", key)


def lead_lag(a: DataFrame, b: DataFrame, max_lag: int) -> DataFrame:
    """(lag, n, corr) of daily counts; positive lag: a leads b. One row of a meets 2 * max_lag + 1 of b."""
    shifted = a.select("date", F.col("n").alias("x")).withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))).withColumn("at", F.date_add("date", F.col("lag")))
    met = shifted.join(b.select(F.col("date").alias("at"), F.col("n").alias("y")), "at")
    return met.groupBy("lag").agg(F.count("*").alias("n"), F.corr("x", "y").alias("corr"))


def diffusion(articles: DataFrame, narrative: str, group: str, ts: str = "published_ts") -> DataFrame:
    """When each group first carries a narrative, in what order, and how many seconds after the first one."""
    first = articles.groupBy(narrative, group).agg(F.min(ts).alias("first_seen"))
    w = Window.partitionBy(narrative)
    return first.withColumn("k", F.row_number().over(w.orderBy("first_seen", group))).withColumn("delay", F.unix_timestamp("first_seen") - F.unix_timestamp(F.min("first_seen").over(w)))


def amplification(articles: DataFrame, narrative: str, group: str) -> DataFrame:
    """A group's share of a narrative over its share of everything."""
    cell = articles.groupBy(narrative, group).agg(F.count("*").alias("n"))
    by_narrative = cell.groupBy(narrative).agg(F.sum("n").alias("in_narrative"))
    by_group = cell.groupBy(group).agg(F.sum("n").alias("in_group"))
    total = cell.agg(F.sum("n").alias("total"))  # one row
    both = cell.join(by_narrative, narrative).join(by_group, group).join(F.broadcast(total))
    return both.select(narrative, group, "n", ((F.col("n") / F.col("in_narrative")) / (F.col("in_group") / F.col("total"))).alias("ratio"))


def search_evidence(articles: DataFrame, terms: Sequence[str], start: str, end: str, k: int, key: str = "article_id", k1: float = 1.2, b: float = 0.75, fields: Sequence[str] = ("text",)) -> DataFrame:
    """BM25 over ``fields`` of the articles of a range of days: the k best with their scores."""
    inside = articles.filter((F.col("published_ts") >= F.lit(start).cast("timestamp")) & (F.col("published_ts") < F.lit(end).cast("timestamp")))
    words = F.filter(F.split(F.lower(F.concat_ws(" ", *fields)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    counted = inside.select(key, words.alias("w")).select(key, F.size("w").alias("len"), *[F.size(F.filter("w", _is(term))).alias(f"tf_{i}") for i, term in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))])
    met = counted.filter(" or ".join(f"tf_{i} > 0" for i in range(len(terms)))).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf_{i}"), F.col(f"df_{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return met.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def _is(term: str):
    return lambda x: x == F.lit(term)


def similar_articles(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", asked: int = 1024, held: int = 8192) -> DataFrame:
    """(query_id, vec_id, score, rank): exact cosines of query vectors against all rows but their own, in blocks.

    Blocks of ``asked`` queries meet blocks of ``held`` rows, and each meeting gives out k rows a query.
    Null, empty and zero vectors, and those of another length than the query, have no cosine.
    """
    plain = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and size(v) > 0 and not exists(v, x -> x is null) and exists(v, x -> x <> 0)")
    rows, asking = plain(vectors), plain(queries)
    n_rows, n_asking = (max(1, -(-df.count() // size)) for df, size in ((rows, held), (asking, asked)))
    dealt = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if left.num_rows and right.num_rows:
            ids, all_v = left["id"].to_numpy(), np.array(left["v"].to_pylist(), object)
            lengths = np.array([len(v) for v in all_v])
            by_length = {n: (ids[lengths == n], np.array(all_v[lengths == n].tolist(), float).reshape(-1, n)) for n in np.unique(lengths)}
            for query, q in zip(right["id"].to_pylist(), right["v"].to_pylist(), strict=True):
                if len(q) not in by_length:
                    continue
                there, v = by_length[len(q)]
                w = np.array(q)
                score = (v * w).sum(axis=1) / np.sqrt((v * v).sum(axis=1) * (w * w).sum())
                score[there == query] = -np.inf
                best = np.lexsort((there, -score))[:k]
                best = best[score[best] > -np.inf]
                for column, x in zip(found, (np.full(len(best), query), there[best], score[best]), strict=True):
                    column.append(x)
        return pa.table({name: np.concatenate(x) for name, x in zip(("query_id", "other_id", "score"), found, strict=True)})

    pairs = dealt(rows, "part", n_rows, "block", n_asking).groupBy("part", "block").cogroup(dealt(asking, "block", n_asking, "part", n_rows).groupBy("part", "block")).applyInArrow(meet, "query_id long, other_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "other_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).withColumnRenamed("other_id", key)


def contributions(events: DataFrame, cell: Sequence[str], weight: str) -> DataFrame:
    """Each event's share of its cell's weight."""
    totals = events.groupBy(*cell).agg(F.sum(weight).alias("cell_weight"))
    return events.join(totals, list(cell)).withColumn("contribution", F.col(weight) / F.col("cell_weight"))


def build_evidence(articles: DataFrame, tags: DataFrame, snippet_chars: int = 200) -> DataFrame:
    """A row per article with its tags, hash and snippet. ``tags``: article_id, tag."""
    tagged = tags.groupBy("article_id").agg(F.array_join(F.sort_array(F.collect_set("tag")), ";").alias("tags"))
    return articles.join(tagged, "article_id", "left").select(
        "article_id", "source_domain", "language", F.coalesce("tags", F.lit("")).alias("tags"), content_hash(F.col("text")).alias("content_hash"), F.substring("text", 1, snippet_chars).alias("snippet")
    )


def timeline_volume(articles: DataFrame, terms: Sequence[str], grain: str, ts: str = "published_ts") -> DataFrame:
    hit = F.lower("text").rlike(any_of(terms))
    return articles.groupBy(F.date_trunc(grain, ts).alias("bucket")).agg(F.count("*").alias("articles"), (F.count_if(hit) / F.count("*")).alias("volume"))
