"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``2**ring_bits`` cells; a row's hash names its cell, and each shard owns the cells
that end in one of its virtual nodes. Only row counts by cell go to the driver (a fixed number,
whatever the input), where they are walked around the ring: a shard takes what hashes to it until
it is full, and what is left continues clockwise to the next virtual node whose shard has room.
Rows then find their place by their rank inside their own cell.

Repeated or null keys share a position on the ring, and one of them may hold a third of all rows. So a
cell's rows are ranked in parts, by a hash of what they carry, each part after the one before it: in
``SALTS`` parts, or in more of about ``PART_ROWS`` rows (of a 131,072th of all rows, if that is more); rows that are equal in all that is returned are counted before they are shuffled, ranked as one,
and dealt out again in bits of ``DEALT``. Which of them gets which slot makes no difference. An empty
table gives no rows. Only the named columns are read, so clashing names elsewhere do no harm.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslens.llm.common import materialize, table, text_or_empty

N_SHARDS = 16
VNODES = 64
RING_BITS = 14
SALTS, DEALT, PART_ROWS, MOST_PARTS = 8, 10_000, 65_536, 131_072


def ring_of(n_shards: int, vnodes: int, ring_bits: int) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise. A shard's nodes don't depend on how many shards there are."""
    nodes = []
    for shard in range(n_shards):
        for v in range(vnodes):
            point = int.from_bytes(hashlib.blake2b(f"shard {shard} node {v}".encode(), digest_size=8).digest(), "big")
            nodes.append((point, shard))
    return [(point >> (64 - ring_bits), shard) for point, shard in sorted(nodes)]


def capacities(n_rows: int, n_shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may hold. Without slack they add up to ``n_rows`` and differ by one at most."""
    if slack > 0:
        most = int(-(-n_rows * (1 + slack) // n_shards))
        return [most] * n_shards
    q, r = divmod(n_rows, n_shards)
    return [q + (s < r) for s in range(n_shards)]


def place(counts: dict[int, int], ring: Sequence[tuple[int, int]], caps: Sequence[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (cell, first rank, end rank, shard, slot of the first rank) that together hold every row once."""
    cells, free = [c for c, _ in ring], list(caps)
    runs: list[tuple[int, int, int, int]] = []
    left: list[tuple[int, int, int, int]] = []
    for cell in sorted(counts):
        home = bisect_left(cells, cell) % len(ring)
        shard, n = ring[home][1], counts[cell]
        took = min(free[shard], n)
        free[shard] -= took
        if took:
            runs.append((cell, 0, took, shard))
        if took < n:
            left.append((cell, took, n, home))
    for cell, start, end, at in left:
        while start < end:
            at = (at + 1) % len(ring)
            shard = ring[at][1]
            if took := min(free[shard], end - start):
                free[shard] -= took
                runs.append((cell, start, start + took, shard))
                start += took
    slots: dict[int, int] = defaultdict(int)
    out = []
    for cell, start, end, shard in sorted(runs):
        out.append((cell, start, end, shard, slots[shard]))
        slots[shard] += end - start
    return out


def shard_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = N_SHARDS, vnodes: int = VNODES, ring_bits: int = RING_BITS, slack: float = 0.0) -> DataFrame:
    """Give every row a shard and a slot: (key, size, text_crc32, shard, slot).

    ``slack`` 0 fills shards to within one row of each other; a positive slack lets a shard hold
    that much over its share, so fewer rows leave the place they hash to.
    """
    spark, body = docs.sparkSession, text_or_empty(text)
    point = F.xxhash64(F.col(key))
    rows = docs.select(
        F.col(key).alias("k"), point.alias("point"), F.shiftrightunsigned(point, 64 - ring_bits).cast("int").alias("cell"),
        (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    packs = materialize(rows.groupBy("k", "point", "cell", "size", "text_crc32").agg(F.count("*").alias("n")), "sharding")  # narrow
    cells = packs.groupBy("cell").agg(F.sum("n").alias("n"))
    each_part = max(PART_ROWS, (cells.agg(F.sum("n")).first()[0] or 0) // MOST_PARTS)
    wide = cells.filter(F.col("n") > SALTS * each_part).select("cell", F.ceil(F.col("n") / each_part).alias("parts")).collect()  # bounded by the ring
    n_parts = F.lit(SALTS)
    if wide:
        packs = packs.join(F.broadcast(spark.createDataFrame([(r["cell"], r["parts"]) for r in wide], "cell int, parts long")), "cell", "left")
        n_parts = F.coalesce("parts", F.lit(SALTS))
    packs = packs.withColumn("salt", F.pmod(F.xxhash64("k", "text_crc32", "size"), n_parts).cast("int"))
    parts = packs.groupBy("cell", "salt").agg(F.sum("n").alias("n"))
    counts: dict[int, int] = defaultdict(int)
    starts = []
    for r in parts.orderBy("cell", "salt").collect():  # bounded by the ring
        starts.append((r["cell"], r["salt"], counts[r["cell"]]))
        counts[r["cell"]] += r["n"]
    runs = place(counts, ring_of(n_shards, vnodes, ring_bits), capacities(sum(counts.values()), n_shards, slack))
    # One row per cell, and one more for each place where a shard is full: bounded by the ring, not by the input.
    plan = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "cell int, first long, end long, shard int, base long")
    begin = spark.createDataFrame(starts, "cell int, salt int, begin long")
    before = Window.partitionBy("cell", "salt").orderBy("point", "k", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = packs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(begin), ["cell", "salt"])
    bits = ranked.withColumn("bit", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / DEALT)))).repartition(F.xxhash64("point", "text_crc32", "bit"))
    each = F.explode(F.sequence(F.col("bit") * DEALT, F.least(F.col("n"), (F.col("bit") + 1) * DEALT) - 1))
    single = bits.withColumn("nth", each).withColumn("rank", F.col("begin") + F.col("before") + F.col("nth"))
    held = (single["cell"] == plan["cell"]) & (single["rank"] >= plan["first"]) & (single["rank"] < plan["end"])
    return single.join(F.broadcast(plan), held).select(
        F.col("k").alias(key), "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
