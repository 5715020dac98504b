"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source that holds ``size`` of all ``total`` bytes and should hold ``weight`` of the mix is to be
repeated ``weight * total / size`` times. Every document draws its own number of copies from the
Poisson distribution of that mean: a uniform number made from a hash of seed, doc_id and text is
looked up in the source's cumulative distribution. Rows are then dealt out and sorted by a hash of
seed, doc_id, text and copy: one global shuffle.

Means over ``PIECE`` are drawn as a sum of independent smaller ones, so that exp(-mean) stays far
from underflow. A null source is a source of its own. Rows that share a doc_id, or have none, draw by
their texts; only rows equal in doc_id and text draw equal counts, and a row number spreads those over
the partitions. A null or empty text counts one byte, so no source has size 0. An empty table gives no
rows. Sources that ``weights`` leaves out get no share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm.common import materialize, table, text_or_empty

SEED = 17
#: Largest mean that is inverted in one piece.
PIECE = 16.0
#: Terms of a piece's distribution: past them less than 2**-53 is left for any mean up to PIECE.
TERMS = 80
#: Up to so many sources the rates are broadcast; beyond, they are joined with salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 64


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) of 52 bits, from the MD5 of the parts joined by colons."""
    joined = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, source: str, text: str) -> DataFrame:
    """(source, rate, pieces, cdf): mean copies, in how many pieces, and the distribution of one piece.

    Without ``weights`` every source gets the same share.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.octet_length(text_or_empty(text)).cast("long") + 1).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        share = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        sizes = sizes.join(share, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sizes = materialize(sizes, "source-sizes")  # a row per source: the texts are read once for it
    whole = sizes.agg(F.sum("size").alias("total"), F.sum("weight").alias("weights")).first()
    total, weights_sum = whole["total"] or 0, whole["weights"] or 0.0
    rate = F.col("weight") / F.lit(float(weights_sum)) * F.lit(total) / F.col("size") if weights_sum > 0 else F.lit(0.0)
    rated = sizes.select("source", rate.alias("rate"))
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1))
    terms = F.expr(f"""transform(aggregate(sequence(1, {TERMS}), array(struct(exp(-mean) as p, exp(-mean) as c)),
        (a, i) -> concat(a, array(struct(element_at(a, -1).p * mean / i as p, element_at(a, -1).c + element_at(a, -1).p * mean / i as c)))), x -> x.c)""")
    return rated.withColumn("pieces", pieces).withColumn("mean", F.col("rate") / F.col("pieces")).select("source", "rate", "pieces", terms.alias("cdf"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED, key: str = "doc_id", source: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns of ``docs`` if not given) of each document once per copy, with ``mix_copy`` (from 0),
    ``mix_rate`` and ``mix_order`` (the key that the shuffle sorts by). Clashing ``mix_`` columns of the input are replaced."""
    keep = [c for c in (keep or docs.columns) if c not in ("mix_copy", "mix_rate", "mix_order")]
    rates = source_rates(docs, weights, source, text)
    n_sources = rates.select("source").limit(BROADCAST_SOURCES + 1).count()
    inner = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(source).alias("doc_source"), F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.md5(text_or_empty(text))).alias("k"))
    if n_sources <= BROADCAST_SOURCES:
        rated = inner.join(F.broadcast(rates), F.col("doc_source").eqNullSafe(F.col("source")))
    else:  # a source may hold a third of all rows: its rate meets it in many tasks
        spread = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = inner.withColumn("doc_salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int"))
        rated = salted.join(spread, F.col("doc_source").eqNullSafe(F.col("source")) & (F.col("doc_salt") == F.col("salt")))
    draws = F.transform(F.sequence(F.lit(1), F.col("pieces").cast("int")), lambda i: uniform(F.lit(str(seed)), F.lit("count"), F.col("k"), i.cast("string")))
    drawn = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("cdf", lambda c: c <= u)))
    counted = rated.withColumn("copies", drawn)
    # explode() leaves out a null, so a document that drew 0 goes
    copies = counted.select("row", "rate", "k", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1))).alias("copy"))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), "k", F.col("copy").cast("string")))
    placed = copies.withColumn("place", place).withColumn("nth", F.monotonically_increasing_id())
    if n_sources > BROADCAST_SOURCES:  # rows come out of a shuffled join in an order that a second run of its task needn't repeat
        placed = materialize(placed, "placed")
    dealt = placed.repartition(F.xxhash64("place", "nth")).sortWithinPartitions("place")
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("copy").alias("mix_copy"), F.col("rate").alias("mix_rate"), F.col("place").alias("mix_order"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy in the mix: doc_id, source, copy, rate, the order key and the text it carries, as its size and MD5."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", "source", F.col("mix_copy").alias("copy_no"), F.round("mix_rate", 9).alias("rate"), F.col("mix_order").alias("order_key"), F.md5(text_or_empty()).alias("text_md5"),
    )


OP6_SQL = f"""
with recursive sized as (
  select doc_id, source, text, octet_length(encode(coalesce(text, '')))::bigint + 1 as size, coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, '')) as k from documents
), rates as (
  select source, 1.0::double / (count(*) over ()) * (sum(sum(size)) over ())::double / sum(size)::double as rate from sized group by source
), pieced as (
  select source, rate, greatest(ceil(rate / {PIECE}), 1)::int as pieces, rate / greatest(ceil(rate / {PIECE}), 1) as mean from rates
), terms as (
  select source, 0 as i, exp(-mean) as p, exp(-mean) as c, mean from pieced
  union all select source, i + 1, p * mean / (i + 1), c + p * mean / (i + 1), mean from terms where i < {TERMS}
), cdf as (select source, list(c order by i) as cs from terms group by source
), drawn as (
  select d.doc_id, d.source, d.text, d.k, r.rate, f.cs,
    unnest(list_transform(range(1, r.pieces + 1), lambda j: ('0x' || substr(md5('{SEED}:count:' || d.k || ':' || j), 1, 13))::bigint / {2**52}::double)) as u,
    row_number() over () as rid
  from sized d join pieced r on d.source is not distinct from r.source join cdf f on d.source is not distinct from f.source
), counted as (
  select rid, any_value(doc_id) as doc_id, any_value(source) as source, any_value(text) as text, any_value(k) as k, any_value(rate) as rate,
    sum(len(list_filter(cs, lambda c: c <= u))) as n from drawn group by rid
), copied as (select *, unnest(range(0, n::bigint)) as copy_no from counted where n > 0)
select doc_id, source, copy_no::int as copy_no, round(rate, 9) as rate, md5('{SEED}:order:' || k || ':' || copy_no) as order_key, md5(coalesce(text, '')) as text_md5 from copied
"""
