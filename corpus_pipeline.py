"""A corpus pipeline over ``documents``: stages of the corpus operators, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm import bpe, line_dedup, mixing, quality_rules, simhash
from presslens.llm.common import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_documents(docs)


def drop_common_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the blocks of lines that an earlier one has. n_chars follows the text."""
    cut = line_dedup.dedup_lines(docs)
    return cut.withColumn("n_chars", F.when(F.size("lines_gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("lines_gone")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints linked by pivot tables, prefix filtering for what they are too far apart for, all verified."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that each source has the same share of the bytes."""
    return mixing.mix(docs).drop("mix_copy", "mix_rate", "mix_order")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digests and that of what they decode to."""
    coded = bpe.bpe_encode(docs, keys=("doc_id", "source"), decoded=True)
    return bpe.digests(coded, ["doc_id", "source", "ids"])


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_common_blocks),
    ("simhash_near_dedup", keep_one_of_each),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Expectation-maximisation, alignment, fingerprints and BPE are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
