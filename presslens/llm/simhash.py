"""SimHash near-dedup: fingerprints linked through tables of distances to reference fingerprints.

Equal fingerprints are one node from the start, so a group of copies costs one row however large it
is. Two fingerprints that differ in at most two bits agree in at least two of four 16-bit blocks, and
their Hamming distances to any reference fingerprint differ by two at most. So every fingerprint goes
to cells named by a pair of its blocks and by its distances to the first ``CELLED`` of ``PIVOTS``
references, cut into ranges of ``RANGE``; where a distance stands within two of a range's lower end,
it goes to the range below as well. Any close pair meets in a cell, and a block that many fingerprints
share is split by its distances. In a cell the distances to all references are tabled, pairs whose
table rows differ by more than two anywhere are discarded, and what is left is compared bit by bit.
A cell gives no pairs out, only one edge from each fingerprint to the smallest of its connected set.
Edges of all cells are then contracted by large-star and small-star steps until nothing moves.

A cell's rows come sorted, as distinct 64-bit values with 32 bits and two ranges of distances in
common; copies and hot sources don't make them more.

A text without words, or a null one, has fingerprint zero and is linked like any other. Rows with
equal doc_id each get their own row. A null doc_id never names a component: a component of rows
without doc_id has a null component_id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm.common import materialize, table, whole_runs, workspace

SHINGLE, SEED, NEAR = 3, 42, 2
PIVOTS, CELLED, RANGE = 24, 2, 8
BLOCKS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    words = (text or b"").lower().split()  # of bytes: lower-cases A-Z alone, splits at the space and tab to carriage return
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 32_768):
        set_bits += np.unpackbits(hashes[at : at + 32_768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): one row per row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"key {kind}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed, random-looking."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}") for i in range(n)], np.uint64)


def tabled_pairs(fps: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of distinct fingerprints within ``near`` bits, by way of the pivot table."""
    tables = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)
    left, right = [], []
    for at in range(0, len(fps), 256):
        i, j = np.nonzero(np.abs(tables[at : at + 256, None, 0] - tables[None, :, 0]) <= near)
        i += at
        i, j = i[i < j], j[i < j]
        for p in range(1, tables.shape[1]):
            if not len(i):
                break
            ok = np.abs(tables[i, p] - tables[j, p]) <= near
            i, j = i[ok], j[ok]
        ok = np.bitwise_count(fps[i] ^ fps[j]) <= near
        left.append(i[ok])
        right.append(j[ok])
    return np.concatenate(left), np.concatenate(right)


def roots_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest index in its connected set."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def cell_edges(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each fingerprint of a cell to the smallest one that it is connected with in there."""
    fps = np.sort(fps)
    root = roots_of(len(fps), *tabled_pairs(fps))
    own = np.flatnonzero(root != np.arange(len(fps)))
    return fps[own], fps[root[own]]


def ranges(fp: str, pivot: int) -> Column:
    """The one or two ranges of distance to ``pivot`` that a fingerprint stands in."""
    far = F.bit_count(F.col(fp).bitwiseXOR(F.lit(pivot)))
    at = F.floor(far / RANGE).cast("int")
    return F.when(far % RANGE < NEAR, F.array(at, at - 1)).otherwise(F.array(at))


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): edges that connect what is connected by pairs of fingerprints within two bits. ``nodes`` has distinct ``fp``."""

    def block(i: int) -> Column:
        return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))

    bits = F.array(*[F.struct(F.lit(k).alias("which"), F.shiftleft(block(i), 16).bitwiseOR(block(j)).alias("bits")) for k, (i, j) in enumerate(BLOCKS)])
    cells = nodes.select("fp", F.explode(bits).alias("k"))
    for i, pivot in enumerate(pivots(CELLED).view(np.int64).tolist()):
        cells = cells.withColumn(f"range_{i}", F.explode(ranges("fp", pivot)))
    # which block pair, its 32 bits and the ranges in one number: 3, 32 and 4 bits each
    name = F.shiftleft(F.col("k.which").cast("long"), 32).bitwiseOR(F.col("k.bits").bitwiseAND(F.lit(0xFFFFFFFF)))
    for i in range(CELLED):
        name = F.shiftleft(name, 4).bitwiseOR((F.col(f"range_{i}") + 1).cast("long"))
    dealt = cells.select(name.alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, fp in whole_runs(batches):
            a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            end = np.append(begin[1:], len(cell))
            for lo, hi in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
                x, y = cell_edges(fp[lo:hi].view(np.uint64))
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't its component's smallest; root is that one.

    Large-star and small-star steps in turn, each pair of steps written before the next begins. Their
    number grows with the logarithm of the longest path.
    """
    with workspace(edges.sparkSession) as work:
        e = work.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        mark = None
        while True:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("at"), F.least("a", "low").alias("low"))
            large = both.filter("b > a").join(low, F.col("a") == F.col("at")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
            lows = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "at")
            small = large.join(lows, F.col("a") == F.col("at")).select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
            e = work.keep(small.select("e.*").filter("a <> b").distinct(), "edges")
            found = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
            if (found["n"], found["x"]) == mark:
                return materialize(e.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
            mark = (found["n"], found["x"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint in hex, component_id) of every row."""
    fps = materialize(fingerprints(docs, key, text), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("key").alias("first")), "nodes")
    roots = components(links(nodes))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    # written, so that both sides of the last join are exchanged for it and a hot fingerprint's rows can be split
    named = materialize(rooted.join(firsts, F.col("root") == F.col("r")).select(F.col("fp").alias("node"), "component_id"), "named")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(named, F.col("fp") == F.col("node")).select(F.col("key").alias(key), digits.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies, by the similarity of five-word shingles."""
    from presslens.llm import near_copies  # which takes components() from here

    return near_copies.one_of_each(docs, key, text)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
