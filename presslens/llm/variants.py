"""Spelling variants: words one letter apart are found by PartEnum signatures and point to the most frequent spelling.

A word is read as the multiset of its letters, a binary vector with one place for each letter and
count ("second e"). Words one inserted, deleted or replaced letter apart differ in two places at most.
The places are dealt to ``PARTS`` parts by a hash; of vectors that differ in two places at least three
parts are equal, so they share a signature: the contents of some three parts. A part's content is a
digest of 12 bits, so that all five fit into one number; an equal digest of unequal parts only costs a
comparison. Two words one letter apart also share their first or their last half (of the shorter one's
length), so that half belongs to the key of the equi-join: without it, families of words made of the
same letters would meet in one key. A pair is kept at the first signature and half that it shares,
which makes pairs unique without a shuffle, and is verified by its edit distance. Spark sizes the exploded
signatures like the words that they come from, some 40 times too low, and would broadcast them through
the driver; so every join of tables that grow with the vocabulary is told to merge.

Nulls: a null text has no words, a null key is written as an empty string. Words are counted over all
documents; equal words are one row. An empty table gives no rows. A word of any length is taken whole:
the work is linear in it, up to its sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm.common import materialize, table, workspace

LETTER = "[A-Za-zÀ-ÿ]"
PARTS, SHARED, BITS = 5, 3, 12
#: Shortest word, fewest occurrences, and how many times as frequent a word's form is.
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: One occurrence in so many loses a letter in ``with_slips``.
SLIP = 199


def lower_ascii(run: Column) -> Column:
    """Lower case for A to Z only."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, ascii_uppercase, ascii_lowercase))


def runs_of(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """(owner, run): each maximal run of at least ``least`` letters, lower-cased; ``owner`` is the key as text."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"({LETTER}{{{least},}})"))
    return docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("owner"), F.explode(found).alias("run")).select("owner", lower_ascii(F.col("run")).alias("run"))


def with_slips(runs: DataFrame) -> DataFrame:
    """(word): runs, of which those whose checksum with their owner is a multiple of ``SLIP`` lose the letter that it names."""
    summed = runs.select("run", F.crc32(F.concat_ws(":", "owner", "run")).alias("sum"))
    at = (F.col("sum") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return summed.select(F.when(F.col("sum") % SLIP == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words that are long and frequent enough."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.length("word") >= least_letters) & (F.col("n") >= least_count))


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that look random, from 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes(words: list[str]) -> np.ndarray:
    """The digests of each word's parts, ``BITS`` bits each, in one number."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    order = np.lexsort((points, owner))
    points, owner = points[order], owner[order]
    begins = np.ones(len(points), bool)
    begins[1:] = (points[1:] != points[:-1]) | (owner[1:] != owner[:-1])
    index = np.arange(len(points))
    nth = index - np.maximum.accumulate(np.where(begins, index, 0))
    place = mixed(points << np.uint64(32) | nth.astype(np.uint64))
    part = (place % np.uint64(PARTS)).astype(np.int64)
    sums = np.zeros(len(words) * PARTS, np.uint64)
    np.bitwise_xor.at(sums, owner * PARTS + part, mixed(place))
    sums = mixed(sums.reshape(-1, PARTS)) & np.uint64((1 << BITS) - 1)
    return (sums << (np.arange(PARTS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).astype(np.int64)


def with_codes(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes(batch.column(0).to_pylist()))], names=["word", "n", "code"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, code long")


def signatures(coded: DataFrame) -> DataFrame:
    """(key, mask, upto, tail, longer, word, n, code): each word once per set of parts, half, and length that a shorter word may have."""
    size = F.length("word")
    chosen = [(sum(((1 << BITS) - 1) << (BITS * p) for p in some), (1 << BITS * (some[-1] + 1)) - 1) for some in combinations(range(PARTS), SHARED)]
    sets = F.array(*[F.struct(F.lit(mask).cast("long").alias("mask"), F.lit(upto).cast("long").alias("upto")) for mask, upto in chosen])
    out = coded.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("tail", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("parts", F.explode(sets))
    half = F.floor((size - F.col("longer")) / 2).cast("int")
    text = F.when(F.col("tail"), F.substring("word", size - half + 1, half)).otherwise(F.substring("word", F.lit(1), half))
    mask = F.col("parts.mask")
    key = F.xxhash64(F.col("code").bitwiseAND(mask), mask, size - F.col("longer"), "tail", text)
    return out.select(key.alias("key"), mask.alias("mask"), F.col("parts.upto").alias("upto"), "tail", "longer", "word", "n", "code")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): pairs of words one letter apart, each once; the shorter or smaller one is ``word``."""
    sides = signatures(with_codes(words))
    a = sides.filter("longer = 0").drop("longer")
    b = sides.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("code").alias("other_code"), "longer")
    differ = F.col("code").bitwiseXOR(F.col("other_code"))
    field = (1 << BITS) - 1
    agreeing = sum((F.when(differ.bitwiseAND(F.lit(field << (BITS * p))) == 0, F.lit(field << (BITS * p)).cast("long")).otherwise(F.lit(0).cast("long")) for p in range(PARTS)), F.lit(0).cast("long"))
    half = F.floor(F.length("word") / 2).cast("int")
    first = (agreeing.bitwiseAND(F.col("upto")) == F.col("mask")) & (~F.col("tail") | (F.substring("word", F.lit(1), half) != F.substring("other", F.lit(1), half)))
    ordered = (F.col("longer") == 1) | (F.col("word") < F.col("other"))
    return a.join(b.hint("merge"), "key").filter(ordered & first & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): how many words are near, and the most frequent of them if it is ``RATIO`` times as frequent."""
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("word")))
    found = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("own"), best.alias("best"))
    fits = -F.col("best.minus") >= RATIO * F.col("own")
    return found.select("word", "n_near", F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of words with a form: their ends by pointer doubling. A form is more frequent than its word, so there are no circles."""
    spark = formed.sparkSession
    with workspace(spark) as work:
        at = work.keep(formed.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
        while not at.filter("moved").isEmpty():
            further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
            at = work.keep(at.drop("moved").join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        return materialize(at.drop("moved"), "roots")


def variant_groups(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table of distinct words and their counts."""
    words = materialize(words.select("word", "n"), "words")
    near = materialize(neighbours(words), "neighbours")
    ends = roots(near.filter(F.col("form").isNotNull()))
    return words.join(near.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"),
    )


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(counted(with_slips(runs_of(table(spark, sf_dir, "documents")))))
