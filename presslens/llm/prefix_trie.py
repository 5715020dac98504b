"""A trie of conversation prefixes from padded matrices of turn ids.

Turns are dealt by ranges, numbered within their conversation and named by two 64-bit hashes of
position, role and text. Every ``WIDTH`` turns make one row, which also carries the digest (exclusive
or of turn ids) of all turns before it, so that a conversation of any length is many rows of bounded
size. Rows are dealt by ranges of block, digest, ids and conversation and sorted: a node's members are
one contiguous run, wherever the ranges are cut, and a prefix that a third of all conversations share is
read by many tasks. A task fills a padded matrix with each batch, sorts it by ``numpy.lexsort``, finds
where nodes begin by OR-accumulating the columns' change masks, and aggregates every depth by
``reduceat``. Nodes at a batch's edges come in pieces and are recombined by their digest.

Sums over subtrees take a second pass over the same rows: a node's own value is written to its smallest
member, each row accumulates values from its last column backwards (and those of the conversation's later
blocks), and a node's subtree is the sum of that over its members.

Rows without a conversation id make no conversation. Null roles and texts are read as empty; turns of one
number are ordered by role and text, equal rows all count; the sign of a remainder is that of the
dividend. Without conversations there are no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslens.llm.common import table
from presslens.scratch import Workspace, materialize, workspace

#: Turns of a row, and characters of a text that its range goes by.
WIDTH, LEADING = 64, 32
#: Conversations of a hundred share the first turns of its first one, so many of them as a checksum modulo 6 says.
FAMILY, SHARED = 100, 6
KEY = ["depth", "hi", "lo"]


def numbered(conversations: DataFrame, work: Workspace) -> DataFrame:
    """(conv_id, at, a, b, chars): place of each turn in its conversation, its ids and the length of its text."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, LEADING)).sortWithinPartitions("conv_id", "turn", "role", "text")
    named = dealt.select(
        "conv_id", F.spark_partition_id().cast("long").alias("part"), F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), "text", "role").alias("b"), F.length("text").cast("long").alias("chars"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, index = batch.column(0).to_numpy(), np.arange(batch.num_rows)
            begins = np.append(True, conv[1:] != conv[:-1])
            at = index - np.maximum.accumulate(np.where(begins, index, 0))
            if conv[0] == last:
                same = begins.cumsum() == 1
                at[same] += seen
            last, seen = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["conv_id", "part", "a", "b", "chars", "at"])

    placed = work.keep(named.mapInArrow(count, "conv_id long, part long, a long, b long, chars long, at long"), "turns")
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only the first conversation of a range can go on from the range before: at most one row for each range is broadcast
    begun = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(ahead)).filter("before > 0").drop("n")
    return placed.join(F.broadcast(begun), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "a", "b", "chars")


def rebuilt(turns: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (with n_turns), and (conv_id, n_turns) of all of them."""
    turn = F.struct("at", "a", "b", "chars")
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("at") < SHARED)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("first"))
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    checksum = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    families = own.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (checksum % SHARED).alias("skip"))
    taken = F.least("skip", F.coalesce(F.size("first"), F.lit(0)))
    joined = families.join(heads, "base", "left").withColumn("taken", F.when(F.col("first").isNull(), 0).otherwise(taken).cast("int"))
    made = work.keep(joined.select("conv_id", "skip", "taken", F.slice("first", 1, F.col("taken")).alias("first"), (F.col("taken") + F.greatest(F.col("own") - F.col("skip"), F.lit(0))).cast("long").alias("n_turns")), "rebuilt")
    given = made.select("conv_id", "n_turns", F.explode("first").alias("t")).select("conv_id", "n_turns", "t.*")
    rest = turns.join(made.drop("first"), "conv_id").filter("at >= skip").select("conv_id", "n_turns", (F.col("at") - F.col("skip") + F.col("taken")).cast("long").alias("at"), "a", "b", "chars")
    return given.unionByName(rest), made.select("conv_id", "n_turns")


def block_rows(turns: DataFrame, convs: DataFrame, work: Workspace) -> DataFrame:
    """A row for each ``WIDTH`` turns: their ids and lengths, and the digest of the turns before."""
    tagged = turns.withColumns({"block": F.floor(F.col("at") / WIDTH), "hi": F.xxhash64("at", "a", "b"), "lo": F.xxhash64("b", "at", "a")})
    made = tagged.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("at", "hi", "lo", "chars"))).alias("t"), F.bit_xor("hi").alias("x_hi"), F.bit_xor("lo").alias("x_lo"), F.max("n_turns").alias("n_turns"))
    kept = work.keep(made.select("conv_id", "block", "n_turns", "x_hi", "x_lo", *[F.col(f"t.{c}").alias(c) for c in ("hi", "lo", "chars")]), "blocks")
    none, longs = F.lit(0).cast("long"), F.array().cast("array<long>")
    bare = convs.filter("n_turns = 0").select("conv_id", none.alias("block"), "n_turns", none.alias("x_hi"), none.alias("x_lo"), longs.alias("hi"), longs.alias("lo"), longs.alias("chars"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    short = kept.filter(F.col("n_turns") <= WIDTH).unionByName(bare).withColumns({"p_hi": none, "p_lo": none})
    long = kept.filter(F.col("n_turns") > WIDTH).withColumns({f"p_{x}": F.coalesce(F.bit_xor(f"x_{x}").over(before), none) for x in ("hi", "lo")})
    return work.keep(short.unionByName(long).withColumn("more", F.col("n_turns") > (F.col("block") + 1) * WIDTH), "rows")


def padded(flat: np.ndarray, mask: np.ndarray) -> np.ndarray:
    out = np.zeros(mask.shape, np.int64)
    out[mask] = flat
    return out


def flat_of(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


class Shard:
    """A batch of rows as matrices in lexicographic order. Columns: conv_id, block, p_hi, p_lo, more, hi, lo, chars."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        conv, block, p_hi, p_lo = (batch.column(i).to_numpy() for i in range(4))
        more = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
        size = pc.list_value_length(batch.column(5)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.width = int(size.max())
        mask = np.arange(self.width) < size[:, None]
        hi, lo, chars = (padded(flat_of(batch.column(i)), mask) for i in (5, 6, 7))
        self.order = order = np.lexsort([conv, *lo.T[::-1], *hi.T[::-1], p_lo, p_hi, block])
        self.conv, self.block, self.more, self.size, self.mask = conv[order], block[order], more[order], size[order], mask[order]
        hi, lo, self.chars, p_hi, p_lo = hi[order], lo[order], chars[order], p_hi[order], p_lo[order]
        # the digest of each prefix; column 0 is that of the turns before
        self.hi, self.lo = (np.bitwise_xor.accumulate(np.column_stack([p, x]), axis=1) for p, x in ((p_hi, hi), (p_lo, lo)))
        changed = np.ones((len(order), self.width + 1), bool)
        changed[1:, 0] = (self.block[1:] != self.block[:-1]) | (p_hi[1:] != p_hi[:-1]) | (p_lo[1:] != p_lo[:-1])
        changed[1:, 1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (self.mask[1:] != self.mask[:-1])
        self.begins = np.logical_or.accumulate(changed, axis=1)[:, 1:] & self.mask

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each column: the rows that reach it, where in them each node begins, and those rows."""
        for j in range(self.width):
            rows = np.flatnonzero(self.mask[:, j])
            first = np.flatnonzero(self.begins[rows, j])
            yield j, rows, first, rows[first]


def gathered(parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=names)


def node_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each batch; ``edge`` marks those that rows of other batches may belong to."""
    for batch in batches:
        if not batch.num_rows or not (s := Shard(batch)).width:
            continue
        ends = np.flatnonzero(np.isin(s.order, [0, len(s.order) - 1]))
        out = []
        for j, rows, first, begin in s.levels():
            inner = np.logical_or.reduceat((s.size[rows] > j + 1) | s.more[rows], first)
            edge = np.zeros(len(first), bool)
            edge[np.searchsorted(begin, ends[s.mask[ends, j]], "right") - 1] = True
            out.append([
                s.block[begin] * WIDTH + j + 1, s.hi[begin, j + 1], s.lo[begin, j + 1], s.hi[begin, j], s.lo[begin, j],
                np.add.reduceat(np.ones(len(rows), np.int64), first), np.minimum.reduceat(s.conv[rows], first), s.chars[begin, j], inner, edge,
            ])
        yield gathered(out, [*KEY, "up_hi", "up_lo", "n", "conv_id", "chars", "inner", "edge"])


def subtree_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the subtree of each node of a batch. Three lists (columns, saved, leaves) and two sums of later blocks follow the row."""
    for batch in batches:
        if not batch.num_rows or not (s := Shard(batch)).width:
            continue
        n = pc.fill_null(pc.list_value_length(batch.column(8)), 0).to_numpy(zero_copy_only=False)
        row, column = np.repeat(np.arange(len(n)), n), flat_of(batch.column(8))
        sums = []
        for values, later in ((9, 11), (10, 12)):
            own = np.zeros((len(n), s.width), np.int64)
            own[row, column] = flat_of(batch.column(values))
            total = np.cumsum(own[:, ::-1], axis=1)[:, ::-1] + batch.column(later).to_numpy()[:, None]
            sums.append(total[s.order])
        out = []
        for j, rows, first, begin in s.levels():
            out.append([s.block[begin] * WIDTH + j + 1, s.hi[begin, j + 1], s.lo[begin, j + 1], *[np.add.reduceat(x[rows, j], first) for x in sums]])
        yield gathered(out, [*KEY, "saved", "leaves"])


def in_order(rows: DataFrame) -> DataFrame:
    by = ["block", "p_hi", "p_lo", "hi", "lo", "conv_id"]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def nodes_of(rows: DataFrame, work: Workspace) -> DataFrame:
    """(depth, hi, lo, up_hi, up_lo, n, conv_id, chars, inner): every node below the root."""
    names = ["conv_id", "block", "p_hi", "p_lo", "more", "hi", "lo", "chars"]
    kinds = "depth long, hi long, lo long, up_hi long, up_lo long, n long, conv_id long, chars long, inner boolean, edge boolean"
    found = work.keep(in_order(rows).select(*names).mapInArrow(node_pieces, kinds), "pieces")
    met = found.filter("edge").groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("up_hi", "up_lo")], F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.first("chars").alias("chars"), F.bool_or("inner").alias("inner"))
    return found.filter("not edge").drop("edge").unionByName(met)


def subtree_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pieces of (depth, hi, lo, saved, leaves); the sums of a node's pieces are those of its subtree."""
    place = F.col("depth") - 1
    saved, leaf = (F.col("n") - 1) * F.col("chars"), (~F.col("inner")).cast("long")
    owned = nodes.select("conv_id", F.floor(place / WIDTH).alias("block"), (place % WIDTH).alias("col"), saved.alias("saved"), leaf.alias("leaf")).filter("saved > 0 or leaf > 0")
    lists = owned.groupBy("conv_id", "block").agg(F.collect_list(F.struct("col", "saved", "leaf")).alias("own"), F.sum("saved").alias("all_saved"), F.sum("leaf").alias("all_leaves"))
    joined = rows.join(lists, ["conv_id", "block"], "left")
    after = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = {"later_saved": "all_saved", "later_leaves": "all_leaves"}
    short = joined.filter(F.col("n_turns") <= WIDTH).withColumns({k: F.lit(0).cast("long") for k in later})
    long = joined.filter(F.col("n_turns") > WIDTH).withColumns({k: F.coalesce(F.sum(v).over(after), F.lit(0)) for k, v in later.items()})
    none = F.array().cast("array<long>")
    names = ["conv_id", "block", "p_hi", "p_lo", "more", "hi", "lo", "chars", *[F.coalesce(F.col(f"own.{c}"), none).alias(f"own_{c}") for c in ("col", "saved", "leaf")], *later]
    return in_order(short.unionByName(long)).select(*names).mapInArrow(subtree_pieces, "depth long, hi long, lo long, saved long, leaves long")


def ends_digest(ends: DataFrame, work: Workspace) -> DataFrame:
    """(depth, hi, lo, sha): SHA-256 of the decimal ids that end at a node, ascending and joined by commas.

    Ids are dealt by ranges. Nodes whose ids lie inside one batch are hashed there; of the others, texts of
    whole batches go to the task that hashes the node, in order: a digest can't be made in parts.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy() for i in range(3)]
            begin = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
            offsets = pa.array(np.append(begin, batch.num_rows).astype(np.int32))
            texts = pc.binary_join(pa.ListArray.from_arrays(offsets, pc.cast(batch.column(3), pa.string())), ",").to_pylist()
            last = len(texts) - 1
            sha = [None if i in (0, last) else hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)]
            body = [t.encode() if i in (0, last) else None for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(k[begin]) for k in keys], batch.column(4).take(pa.array(begin)), pa.array(np.full(len(begin), piece)), pa.array(body, pa.binary()), pa.array(sha, pa.string())],
                names=[*KEY, "part", "piece", "body", "sha"],
            )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in key], pa.array([digest.hexdigest()])], names=[*KEY, "sha"])

        for batch in batches:
            for *now, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != key:
                    if digest:
                        yield closed()
                    key, digest = now, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(body)
        if digest:
            yield closed()

    by = [*KEY, "conv_id"]
    dealt = ends.repartitionByRange(*by).sortWithinPartitions(*by).select(*by, F.spark_partition_id().cast("long").alias("part"))
    pieces = work.keep(dealt.mapInArrow(joined, "depth long, hi long, lo long, part long, piece long, body binary, sha string"), "ends")
    parted = pieces.filter("sha is null").repartition(*KEY).sortWithinPartitions(*KEY, "part", "piece").select(*KEY, "body")
    return pieces.filter("sha is not null").select(*KEY, "sha").unionByName(parted.mapInArrow(hashed, "depth long, hi long, lo long, sha string"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node of the trie: ``turns`` (conv_id, at, a, b, chars, n_turns), ``convs`` (conv_id, n_turns).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    zero = F.lit(0).cast("long")
    with workspace(turns.sparkSession) as work:
        rows = block_rows(turns, convs, work)
        nodes = nodes_of(rows, work)
        top = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), (F.coalesce(F.max("n_turns"), zero) > 0).alias("inner")).filter("n > 0")
        top = work.keep(top, "root")
        sums = subtree_sums(rows, nodes)
        all_sums = nodes.agg(F.coalesce(F.sum((F.col("n") - 1) * F.col("chars")), zero).alias("saved"), F.coalesce(F.sum((~F.col("inner")).cast("long")), zero).alias("leaves"))
        ended = rows.filter("not more").select("n_turns", *[F.col(f"p_{x}").bitwiseXOR(F.col(f"x_{x}")).alias(x) for x in ("hi", "lo")], "conv_id").withColumnRenamed("n_turns", "depth")
        below = nodes.select((F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo"), F.lit(1).cast("long").alias("n_children"))
        above = nodes.select(*KEY, "up_hi", "up_lo", "n", "conv_id")
        root = top.crossJoin(all_sums).select(*[zero.alias(c) for c in (*KEY, "up_hi", "up_lo")], "n", "conv_id", "saved", F.when(F.col("inner"), F.col("leaves")).otherwise(1).cast("long").alias("leaves"))
        parts = above.unionByName(root, True).unionByName(sums, True).unionByName(below, True).unionByName(ends_digest(ended, work), True)
        added = [F.sum(c).alias(c) for c in ("n_children", "saved", "leaves")]
        merged = parts.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in ("up_hi", "up_lo", "n", "conv_id", "sha")], *added)
        merged = work.keep(merged, "nodes")
        # the root is above a large part of all nodes, and is one row
        parents = merged.filter("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"))
        deep = merged.filter("depth > 1").join(parents, ["depth", "up_hi", "up_lo"])
        first = merged.filter("depth = 1").crossJoin(F.broadcast(top.select(F.col("conv_id").alias("parent_conv_id"))))
        every = deep.unionByName(first).unionByName(merged.filter("depth = 0"), True)
        return materialize(every.select(
            "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"), F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        ), "trie")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with workspace(spark) as work:
        return prefix_trie(*rebuilt(numbered(table(spark, sf_dir, "conversations"), work), work))
