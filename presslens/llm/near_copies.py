"""Near copies by similarity: groups of texts linked by a Jaccard similarity of 0.8 or more of their word shingles.

A text is the set of the 64-bit hashes of its runs of ``SIZE`` words; equal sets are one node from the
start. Every node has a SimHash fingerprint of its set, and fingerprints within two bits of each other
are linked through tables of distances to reference fingerprints (``simhash.links``); nodes with the
same or linked fingerprints are the first candidates. Pairs of a similarity near 0.8 differ in more bits
than any such table can use, so exact prefix filtering finds the rest: in one order of all shingles, two sets this similar
share one of the first fifth (and one more) of each. The order puts shingles that a sample of the
documents holds often last; it sets the work, not what is found. Before its first shingle that another
set has too, each has only shingles that the other has not, so the places of that shingle in both bound
what they can have in common; a pair out of reach by the places of a shingle is not made there, and one
that is similar is made at the first that it shares. Where a shingle has up to ``SHORT`` nodes, all its
pairs within reach are compared. Where it has more, each is first compared with the ``HUBS`` sets of a
fitting size that have it foremost, which have the least of their own and so the most in common with
others, and then with all within reach that it is not connected with by then. So nodes of a large group
of near copies take a few pairs each, once they are connected; those within reach of each other that no
link connects still have to be told apart pair by pair. Every node carries a sketch, the
``SKETCH`` smallest of its shingles' hashes by another hash. Where at most ``UNLIKE`` of the smallest of
both are in common, the candidate is dropped: for a pair of similarity 0.8 that has a probability under
1e-10, and sets of up to ``SKETCH`` shingles are compared whole. Every pair that is left is verified on
the whole sets, which are made for the texts of these alone.

A text of fewer words than ``SIZE`` is one shingle; texts without words, or null ones, are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslens.llm.common import materialize, whole_runs, workspace
from presslens.llm.simhash import components, links

SIZE, SEED = 5, 42
SHORT, HUBS, SKETCH, UNLIKE = 16, 4, 32, 8
SAMPLED, SHARE, OFTEN, LISTED = 5_000, 0.02, 4, 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)
PAIR = "a long, b long"


def shingles(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, as signed longs."""
    words = (text or b"").lower().split()
    size = min(size, len(words))
    if not size:
        return np.empty(0, np.int64)
    each = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ each[k : k + len(out)]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def similar(both: int, n: int, m: int) -> bool:
    """Whether sets of n and m with ``both`` in common have a Jaccard similarity of 0.8 or more."""
    return 5 * both >= 4 * (n + m - both)


def often_held(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of ``docs`` (key, th, text) holds often, sorted, and in how many of its documents."""
    share = min(1.0, max(SHARE, SAMPLED / max(docs.count(), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *(shingles(t.as_py()) for t in batch.column(0))]))], names=["h"])

    sample = docs.filter(F.pmod(F.xxhash64("key", "th"), F.lit(10_000)) < int(np.ceil(10_000 * share))).select("text")
    top = sample.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(LISTED).collect()
    found = np.array(sorted((r["h"], r["count"]) for r in top), np.int64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def prefix(found: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which another set, to be similar, has to have one in its own prefix."""
    if not len(found):
        return found
    held = np.zeros(len(found), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        held = np.where(often[at] == found, counts[at], 0)
    return found[np.argsort(held, kind="stable")[: len(found) // 5 + 1]]


def sketch(found: np.ndarray) -> bytes:
    """The smallest of the shingles' hashes by another hash, sorted."""
    mixed = (found.view(np.uint64) ^ (found.view(np.uint64) >> np.uint64(31))) * MIX
    return np.sort(np.partition(mixed, SKETCH - 1)[:SKETCH] if len(mixed) > SKETCH else mixed).tobytes()


def print_of(found: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed long: a bit is 1 if it is in over half of them."""
    held = np.zeros(64, np.int64)
    for at in range(0, len(found), 32_768):
        held += np.unpackbits(found[at : at + 32_768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * held > len(found), bitorder="little").view(np.int64)[0])


def alike(x: bytes, y: bytes) -> bool:
    """Whether more than ``UNLIKE`` of the smallest hashes of both sketches' union are in both; small sets are compared whole."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) < SKETCH and len(b) < SKETCH:
        return similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))
    least = np.union1d(a, b)[:SKETCH]
    return len(np.intersect1d(np.intersect1d(least, a, assume_unique=True), b, assume_unique=True)) > UNLIKE


def nodes_of(docs: DataFrame) -> DataFrame:
    """(key, th, node, n, fp, sketch, keys) of each row of ``docs`` (key, th, text): its set's hash, size, fingerprint, sketch and prefix."""
    often, counts = often_held(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(2)]
            names = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
            keys = pa.array([prefix(s, often, counts) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array([len(s) for s in sets], pa.int32()), pa.array([print_of(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), keys], names=["key", "th", "node", "n", "fp", "sketch", "keys"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "th", "text").mapInArrow(run, f"key {kind}, th long, node long, n int, fp long, sketch binary, keys array<long>")


def shared(nodes: DataFrame) -> DataFrame:
    """(h, nodes, sizes, places): for each prefix shingle of two nodes or more, those nodes by size, and its place in each."""

    def groups(h: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((node, n, h))
        h, node, n, place = h[order], node[order], n[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node, n, place = h[new], node[new], n[new], place[new]
        _, which, size = np.unique(h, return_inverse=True, return_counts=True)
        many = size[which] > 1
        h, node, n, place = h[many], node[many], n[many], place[many]
        names, starts = np.unique(h, return_index=True)
        ends = pa.array(np.append(starts, len(h)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (node, n, place)]
        return pa.RecordBatch.from_arrays([pa.array(names), *lists], names=["h", "nodes", "sizes", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches):
            yield groups(*rows)

    rows = nodes.select(F.posexplode("keys").alias("place", "h"), "node", "n").select("h", "node", "n", "place")
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, nodes array<long>, sizes array<int>, places array<int>")


def within_reach(sizes: np.ndarray, places: np.ndarray, at: int, others: slice) -> np.ndarray:
    """Which of ``others`` can be similar to the set ``at``, if what has these places is the first that both hold."""
    both = np.minimum(sizes[at] - places[at], sizes[others] - places[others]).astype(np.int64)
    return 9 * both >= 4 * (sizes[others].astype(np.int64) + sizes[at])


def first_pairs(nodes: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within reach of each other, sizes rising: all of a short list, else each with the foremost of fitting size."""
    at = 0
    while at < len(nodes):
        end = int(np.searchsorted(sizes, sizes[at] * 5 // 4, side="right"))
        if len(nodes) <= SHORT:
            to = nodes[at + 1 : end][within_reach(sizes, places, at, slice(at + 1, end))]
            yield np.full(len(to), nodes[at]), to
            at += 1
        else:
            for hub in at + np.argsort(places[at:end], kind="stable")[:HUBS]:
                to = nodes[at:end][within_reach(sizes, places, hub, slice(at, end))]
                to = to[to != nodes[hub]]
                yield np.full(len(to), nodes[hub]), to
            at = end


def other_pairs(nodes: np.ndarray, sizes: np.ndarray, places: np.ndarray, roots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within reach of each other, sizes rising, with different roots."""
    if (roots == roots[0]).all():
        return
    for at in range(len(nodes)):
        end = int(np.searchsorted(sizes, sizes[at] * 5 // 4, side="right"))
        later = slice(at + 1, end)
        to = nodes[later][(roots[later] != roots[at]) & within_reach(sizes, places, at, later)]
        yield np.full(len(to), nodes[at]), to


def pairs_of(lists: DataFrame, by) -> DataFrame:
    """(a, b), a < b: the pairs that ``by`` makes of each row's arrays."""

    def batch_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = [], 0
            for row in range(batch.num_rows):
                for pair in by(*(c[row].values.to_numpy(zero_copy_only=False) for c in batch.columns)):
                    found.append(pair)
                    n += len(pair[0])
                    if n > 500_000:
                        yield batch_of(found)
                        found, n = [], 0
            yield batch_of(found)

    return lists.mapInArrow(run, PAIR).distinct()


def printed_pairs(firsts: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes of ``firsts`` (node, fp) beside the smallest node of their fingerprint, and those of linked fingerprints beside each other."""
    prints = firsts.groupBy("fp").agg(F.min("node").alias("low"))
    same = firsts.join(prints, "fp").select(F.col("low").alias("a"), F.col("node").alias("b"))
    x, y = (prints.select(F.col("fp").alias(f"{s}_fp"), F.col("low").alias(s)) for s in ("x", "y"))
    near = links(prints.select("fp")).distinct().join(x, F.col("a") == F.col("x_fp")).join(y, F.col("b") == F.col("y_fp"))
    return same.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).filter("a <> b")


def likely(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """``pairs`` without those whose sketches are not alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([alike(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], names=["a", "b"])

    left, right = (firsts.select(F.col("node").alias(f"{s}_node"), F.col("first.sketch").alias(s)) for s in ("x", "y"))
    both = pairs.join(left, F.col("a") == F.col("x_node")).join(right, F.col("b") == F.col("y_node"))
    return both.select("a", "b", "x", "y").mapInArrow(run, PAIR)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose ``sets`` (node, found) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in range(batch.num_rows):
                x, y = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                keep.append(similar(len(x) + len(y) - len(np.union1d(x, y)), len(x), len(y)))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], names=["a", "b"])

    left, right = (sets.select(F.col("node").alias(f"{s}_node"), F.col("found").alias(s)) for s in ("x", "y"))
    both = pairs.join(left, F.col("a") == F.col("x_node")).join(right, F.col("b") == F.col("y_node"))
    return both.select("a", "b", "x", "y").mapInArrow(run, PAIR)


def sets_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, found): the shingles of each of the ``chosen`` (k, t, node) documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows with the same key and text are equal, and one of them will do
        for batch in batches:
            new = [row for row, node in enumerate(batch.column(0).to_pylist()) if not (node in seen or seen.add(node))]
            found = [shingles(batch.column(1)[row].as_py()) for row in new]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(new, pa.int64())), pa.array(found, pa.list_(pa.int64()))], names=["node", "found"])

    texts = docs.join(chosen, (F.col("key") == F.col("k")) & (F.col("th") == F.col("t")))
    return texts.select("node", "text").mapInArrow(run, "node long, found array<long>")


def winners(docs: DataFrame) -> DataFrame:
    """(k, t): key and text hash of the first document of each group of near copies in ``docs`` (key, th, text)."""
    with workspace(docs.sparkSession) as work:
        rows = work.keep(nodes_of(docs), "nodes")
        firsts = work.keep(rows.groupBy("node").agg(F.min(F.struct("key", "th", "n", "sketch")).alias("first"), F.min("fp").alias("fp")), "firsts")
        lists = work.keep(shared(rows), "lists")

        def edges_of(candidates: DataFrame) -> DataFrame | None:
            pairs = work.keep(likely(candidates, firsts), "pairs")
            if pairs.isEmpty():
                return None
            met = pairs.select(F.explode(F.array("a", "b")).alias("m")).distinct()
            chosen = firsts.join(met, F.col("node") == F.col("m"), "left_semi").select(F.col("first.key").alias("k"), F.col("first.th").alias("t"), "node")
            return work.keep(verified(pairs, work.keep(sets_of(docs, chosen), "sets")), "edges")

        printed = printed_pairs(firsts.select("node", "fp"))
        edges = edges_of(printed.unionByName(pairs_of(lists.select("nodes", "sizes", "places"), first_pairs)).distinct())
        edges = firsts.sparkSession.createDataFrame([], PAIR) if edges is None else edges
        roots = components(edges)
        long = lists.filter(F.size("nodes") > SHORT).select("h", F.explode(F.arrays_zip("sizes", "nodes", "places")).alias("e"))
        named = long.join(roots, F.col("e.nodes") == roots["node"], "left").select("h", F.struct("e.sizes", "e.nodes", "e.places", F.coalesce("root", "e.nodes").alias("root")).alias("e"))
        again = named.groupBy("h").agg(F.sort_array(F.collect_list("e")).alias("e"), F.min("e.root").alias("low"), F.max("e.root").alias("high")).filter("low < high")
        more = edges_of(pairs_of(again.select("e.nodes", "e.sizes", "e.places", "e.root"), other_pairs))
        if more is not None:
            roots = components(edges.unionByName(more))
        ends = firsts.join(roots.select(F.col("node").alias("at"), "root"), F.col("node") == F.col("at"), "left")
        first = ends.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.key").alias("k"), F.col("first.th").alias("t"))
        return materialize(first, "stay")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest ``key``.

    Rows that share that key are told apart by their text; of equal ones one stays. Rows without a key
    take no part and stay.
    """
    columns = docs.columns
    known = docs.filter(F.col(key).isNotNull())
    stay = winners(known.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("text")))
    row = known.select(F.struct(*columns).alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("th"))
    kept = row.join(stay, (F.col("key") == F.col("k")) & (F.col("th") == F.col("t")), "left_semi")
    first = kept.withColumn("nth", F.row_number().over(Window.partitionBy("key", "th").orderBy(f"row.{text}"))).filter("nth = 1")
    return first.select("row.*").unionByName(docs.filter(F.col(key).isNull()))
