"""Texts linked by the Jaccard similarity of their word shingles: every link, without all pairs.

A text is the set of the 64-bit hashes of its runs of ``SIZE`` words, and equal sets are one node. In one
order of all shingles, two sets of n and m with a similarity of t or more share one of the first
n - tn + 1 of each, so only these are shuffled, and sets meet in the list of a shingle. The order puts
shingles that a sample holds often last; it sets the work, not what is found. At the first shingle that
both hold, their places bound what they can have in common, and a pair out of reach by them is not made.

Lists of up to ``SHORT`` sets give all their pairs. In longer ones each set first meets ``HUBS`` sets of a
fitting size, and when what these link is known, the list is cut into blocks of ``BLOCK`` sets and all
blocks meet, each pair of blocks in a task of its own; only pairs that nothing connects yet are looked at.
So a large group of near copies makes a few pairs a set.

Each node has a bitmap of ``WIDTH`` bits with the parity of how many of its shingles fall on each, and one
of ``WIDE`` bits if it holds over ``LONG``. An element that only one of two sets holds changes one bit, so
bitmaps that differ in more bits than the sets may differ in elements rule a pair out, for certain. What is
left is verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.functions.runs import whole_runs
from presslens.operators.graph import min_labels
from presslens.scratch import Workspace, materialize, workspace

SIZE, AT_ONCE = 5, 1 << 18
WIDTH, WIDE, LONG = 1024, 8192, 1000
SHORT, HUBS, BLOCK = 16, 4, 1024
SAMPLED, SHARE, OFTEN, LISTED = 5_000, 0.02, 4, 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)
ROUNDING = 1e-9
PAIR = "a long, b long"


def mixed(x: np.ndarray) -> np.ndarray:
    """Each of the numbers spread over 64 bits."""
    x = (x.astype(np.uint64) + np.uint64(1)) * MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What each value of a byte stands for, and which are ASCII white space.
BYTE = mixed(np.arange(256))
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def word_hashes(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``joined`` (bytes that end in a blank) begin, and their hashes: sums of what a byte and its place stand for."""
    blank = BLANK[joined]
    other = ~blank
    starts = np.flatnonzero(other & np.concatenate([[True], blank[:-1]]))
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    lengths = np.flatnonzero(blank & np.concatenate([[False], other[:-1]])) - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    return starts, mixed(np.add.reduceat(BYTE[joined[other]] * mixed(np.arange(lengths.max()) + 256)[place], first))


def shingles(texts: list[bytes], size: int = SIZE) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its word shingles, as signed longs; fewer words than ``size`` are one shingle."""
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(np.cumsum([len(t) for t in texts[at : at + 1024]]), AT_ONCE, side="right")) + at
        some = texts[at : max(end, at + 1)]
        at += len(some)
        starts, words = word_hashes(np.frombuffer(b"\n".join([*some, b""]), np.uint8))
        stops = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in some])).tolist()
        runs = np.full(max(len(words) - size + 1, 0), size, np.uint64)
        for k in range(size):
            runs = (runs ^ words[k : k + len(runs)]) * MIX
            runs ^= runs >> np.uint64(29)
        for lo, hi in pairwise([0, *stops]):
            if hi - lo >= size:
                own = np.sort(runs[lo : hi - size + 1].view(np.int64))
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            else:
                own = np.full(min(hi - lo, 1), hi - lo, np.uint64)
                for word in words[lo:hi]:
                    own = (own ^ word) * MIX
                    own ^= own >> np.uint64(29)
                yield own.view(np.int64)


def parities(found: np.ndarray, width: int) -> bytes:
    """Of the numbers of shingles that fall on each of ``width`` places, packed."""
    return np.packbits(np.bincount(found & (width - 1), minlength=width).astype(np.uint8) & 1).tobytes()


def within_reach(threshold: float, n: np.ndarray, m: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` that have ``both`` in common are similar."""
    return both * (1 + threshold) >= threshold * (n.astype(np.int64) + m) - ROUNDING


def not_ruled_out(threshold: float, n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` with the bitmaps ``x`` and ``y`` (rows of 64-bit words) can be similar."""
    apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return within_reach(threshold, n, m, (n.astype(np.int64) + m - apart) // 2)


def bitmaps(bits: pa.Array, width: int = WIDTH) -> np.ndarray:
    return np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(-1, width // 64)


def pair_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, k].copy()) for k in (0, 1)], names=["a", "b"])


def sets_of(texts: DataFrame) -> DataFrame:
    """(key, node, n, found, bits, wide) of each row of ``texts`` (key, text): its set's hash, size, shingles and bitmaps.

    A task gives a node's shingles and bitmaps once. Null texts are a node, and so are those without words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            given = batch.column(1).to_pylist()
            rows = []
            for text, s in zip(given, shingles([t or b"" for t in given]), strict=True):
                packed = b"null" if text is None else s.tobytes()
                node = xxhash.xxh64_intdigest(packed)
                if not len(s) or node in seen:
                    rows.append((node, len(s), None, None, None))
                else:
                    seen.add(node)
                    rows.append((node, len(s), packed, parities(s, WIDTH), parities(s, WIDE) if len(s) > LONG else None))
            nodes, sizes, found, bits, wide = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [batch.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), *[pa.array(x, pa.binary()) for x in (found, bits, wide)]]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "n", "found", "bits", "wide"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.mapInArrow(run, f"key {kind}, node long, n int, found binary, bits binary, wide binary")


def often_held(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of ``sets`` holds often, sorted, and in how many of its rows."""
    share = min(1.0, max(SHARE, SAMPLED / max(sets.count(), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))], names=["h"])

    sample = sets.filter(F.pmod(F.xxhash64("node"), F.lit(10_000)) < int(np.ceil(10_000 * share))).select("found")
    top = sample.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(LISTED).collect()
    found = np.array(sorted((r["h"], r["count"]) for r in top), np.int64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(h, node, n, place, before): the shingles of which another set, to be similar, has to have one among its own; ``before`` is the one at the place before."""
    often, counts = often_held(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            lengths = sizes - np.ceil(sizes * threshold - ROUNDING).astype(np.int64) + 1
            h, before = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for packed, length in zip(batch.column(2).to_pylist(), lengths.tolist(), strict=True):
                s = np.frombuffer(packed, np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    held = np.where(often[at] == s, counts[at], 0)
                    s = s[np.argsort(held, kind="stable")]
                s = s[:length]
                h.append(s)
                before.append(np.concatenate([s[:1], s[:-1]]))  # the first one has itself there
            lengths = np.minimum(lengths, sizes)
            place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            columns = [np.concatenate(h), np.repeat(batch.column(0).to_numpy(), lengths), np.repeat(sizes, lengths), place.astype(np.int32), np.concatenate(before)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "node", "n", "place", "before"])

    return sets.select("node", "n", "found").mapInArrow(run, "h long, node long, n int, place int, before long")


def meetings(rows: DataFrame, threshold: float) -> DataFrame:
    """What ``prefixes`` gives, by shingle: pairs (a, b) where h is null, and the rows of long lists (h, block, a, n, place, before)."""

    def to_hubs(node: np.ndarray, n: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = 0
        while at < len(node):
            end = int(np.searchsorted(n, n[at] / threshold + ROUNDING, side="right"))
            for hub in at + np.argsort(place[at:end], kind="stable")[:HUBS]:
                both = np.minimum(n[hub] - place[hub], n[at:end] - place[at:end])
                to = node[at:end][within_reach(threshold, n[at:end], n[hub], both)]
                yield np.full(len(to), node[hub]), to
            at = end

    def out(columns: dict[str, pa.Array], length: int) -> pa.RecordBatch:
        kinds = {"h": pa.int64(), "block": pa.int32(), "a": pa.int64(), "b": pa.int64(), "n": pa.int32(), "place": pa.int32(), "before": pa.int64()}
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(length, kind)) for c, kind in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, node, n, place, before in whole_runs(batches):
            new = np.concatenate([[True], h[1:] != h[:-1], [True]])
            order = np.flatnonzero(~(new[1:] & new[:-1]))  # what only one row holds links nothing
            order = order[np.lexsort((node[order], n[order], h[order]))]
            order = order[np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (node[order][1:] != node[order][:-1])])[: len(order)]]
            cuts = np.concatenate([[0], np.flatnonzero(h[order][1:] != h[order][:-1]) + 1, [len(order)]])
            held = np.repeat(np.diff(cuts), np.diff(cuts))
            i = order[(held > 1) & (held <= SHORT)]
            a, b = [], []
            for k in range(1, SHORT):
                x, y = i[:-k], i[k:]
                met = h[x] == h[y]
                if not met.any():
                    break
                x, y = x[met], y[met]
                # where the places before hold the same shingle, the two have met in its list
                met = ((before[x] != before[y]) | (place[x] == 0) | (place[y] == 0)) & within_reach(threshold, n[x], n[y], np.minimum(n[x] - place[x], n[y] - place[y]))
                a.append(node[x[met]])
                b.append(node[y[met]])
            i = order[held > SHORT]
            cuts = np.flatnonzero(np.diff(h[i])) + 1
            for lo, hi in pairwise([0, *cuts.tolist(), len(i)] if len(i) else []):
                own = i[lo:hi]
                for x, y in to_hubs(node[own], n[own], place[own]):
                    a.append(x[x != y])
                    b.append(y[x != y])
                block = np.arange(len(own), dtype=np.int32) // BLOCK
                yield out({"h": pa.array(h[own]), "block": pa.array(block), "a": pa.array(node[own]), "n": pa.array(n[own]), "place": pa.array(place[own]), "before": pa.array(before[own])}, len(own))
            pairs = pair_batch(a, b)
            yield out({"a": pairs.column(0), "b": pairs.column(1)}, pairs.num_rows)

    dealt = rows.repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "h long, block int, a long, b long, n int, place int, before long")


def block_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of ``rows`` (h, block, n, node, place, before, root, bits) of one shingle that have different roots and can be similar."""
    each = F.struct("n", "node", "place", "before", "root", "bits")
    blocks = rows.groupBy("h", "block").agg(F.collect_list(each).alias("e"), F.min("n").alias("low"), F.max("n").alias("high"))
    left, right = (blocks.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "e", "low", "high")]) for s in ("x", "y"))
    fits = (F.col("block_x") <= F.col("block_y")) & (F.col("high_x") >= threshold * F.col("low_y") - ROUNDING)
    both = left.join(right, "h").filter(fits).repartition("h", "block_x", "block_y").select("block_x", "block_y", "e_x", "e_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = (batch.column(c)[row].values for c in (2, 3))
                (n, node, place, before, root), (m, other, at, after, top) = ([s.field(k).to_numpy() for k in range(5)] for s in (x, y))
                own = batch.column(0)[row] == batch.column(1)[row]
                bits, beside = bitmaps(x.field(5)), bitmaps(y.field(5))
                for lo in range(0, len(node), 64):
                    part = slice(lo, lo + 64)
                    met = (root[part, None] != top) & ((before[part, None] != after) | (place[part, None] == 0) | (at == 0))
                    met &= within_reach(threshold, n[part, None], m, np.minimum((n - place)[part, None], m - at))
                    i, j = np.nonzero(met)
                    i += lo
                    if own:
                        i, j = i[i < j], j[i < j]
                    a, b = [], []
                    for some in range(0, len(i), 16_384):
                        p, q = i[some : some + 16_384], j[some : some + 16_384]
                        ok = not_ruled_out(threshold, n[p], m[q], bits[p], beside[q])
                        a.append(node[p[ok]])
                        b.append(other[q[ok]])
                    if a:
                        yield pair_batch(a, b)

    return both.mapInArrow(run, PAIR)


def beside(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with what ``nodes`` has of a (x_...) and of b (y_...)."""
    left, right = (nodes.select(F.col("node").alias(f"{s}_node"), *[F.col(c).alias(f"{s}_{c}") for c in columns]) for s in ("x", "y"))
    both = pairs.join(left, F.col("a") == F.col("x_node")).join(right, F.col("b") == F.col("y_node"))
    return both.select("a", "b", *[f"{s}_{c}" for s in ("x", "y") for c in columns])


def likely(pairs: DataFrame, firsts: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` that the bitmaps of ``firsts`` (node, n, bits, wide) don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in (2, 5))
            keep = not_ruled_out(threshold, n, m, bitmaps(batch.column(3)), bitmaps(batch.column(6)))
            both = np.flatnonzero(keep & (n > LONG) & (m > LONG))
            for some in np.split(both, range(4096, len(both), 4096)):
                keep[some] = not_ruled_out(threshold, n[some], m[some], *(bitmaps(batch.column(c).take(pa.array(some)), WIDE) for c in (4, 7)))
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], names=["a", "b"])

    return beside(pairs, firsts, "n", "bits", "wide").mapInArrow(run, PAIR)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` whose ``sets`` (node, found) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - ROUNDING)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], names=["a", "b"])

    return beside(pairs, sets, "found").mapInArrow(run, PAIR)


def roots_of(work: Workspace, sets: DataFrame, firsts: DataFrame, threshold: float) -> DataFrame | None:
    """(node, label) of the nodes that are linked to others; None if none is."""

    def edges_of(candidates: DataFrame) -> DataFrame | None:
        pairs = work.keep(likely(candidates, firsts, threshold), "pairs")
        if pairs.isEmpty():
            return None
        met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        chosen = work.keep(sets.select("node", "found").join(met, "node", "left_semi").dropDuplicates(["node"]), "chosen")
        return work.keep(verified(pairs, chosen, threshold), "edges")

    met = work.keep(meetings(prefixes(sets, threshold), threshold), "met")
    edges = edges_of(met.filter("h is null").select("a", "b").distinct())
    roots = None if edges is None else min_labels(edges)
    long = met.filter("h is not null").select("h", "block", F.col("a").alias("node"), "place", "before")
    if long.isEmpty():
        return roots
    label: Column = F.col("node")
    if roots is not None:
        long, label = long.join(roots, "node", "left"), F.coalesce("label", "node")
    rooted = work.keep(long.select("h", "block", "node", "place", "before", label.alias("root")), "rooted")
    apart = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("h")
    rest = rooted.join(apart, "h", "left_semi").join(firsts.select("node", "n", "bits"), "node")
    more = edges_of(work.keep(block_pairs(rest, threshold).distinct(), "rest"))
    if more is None:
        return roots
    return min_labels(more if edges is None else edges.unionByName(more))


def similar_groups(texts: DataFrame, threshold: float) -> DataFrame:
    """(key, group_id) of each row of ``texts`` (key, text): the smallest key of what links of ``threshold`` or more connect it with.

    ``text`` is binary, and its words stand between ASCII white space. Texts without words are equal, and so are null ones.
    """
    with workspace(texts.sparkSession) as work:
        rows = work.keep(sets_of(texts), "sets")
        firsts = work.keep(rows.groupBy("node").agg(F.min("key").alias("first"), F.max("n").alias("n"), *[F.first(c, ignorenulls=True).alias(c) for c in ("bits", "wide")]), "firsts")
        roots = roots_of(work, rows.filter("found is not null"), firsts.filter("n > 0"), threshold)
        named = firsts.select("node", F.col("first").alias("group_id"))
        if roots is not None:
            linked = firsts.join(roots, "node", "left").select("node", "first", F.coalesce("label", "node").alias("root"))
            lowest = linked.groupBy("root").agg(F.min("first").alias("group_id"))
            named = linked.join(lowest, "root").select("node", "group_id")
        # written, so that both sides of the last join are exchanged for it and a hot node's rows can be split
        return materialize(rows.select("key", "node").join(work.keep(named, "named"), "node").select("key", "group_id"), "groups")
