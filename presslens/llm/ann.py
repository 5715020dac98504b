"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` distinct vectors) and has a bounded number of
leaves; every row is indexed, by descending to the nearest child at each level. A query keeps a
priority queue of nodes by the cosine to their centre and visits leaves in that order. How many
is calibrated: for ``CALIBRATION`` queries the exact neighbours among all rows are found in blocks,
and visits are widened until ``RECALL`` of those neighbours lie in visited leaves. A query whose leaves
hold fewer than k candidates goes on until they do, or to the last leaf.

Rows with the very same vector have the same cosine to everything, so of each distinct vector only
the k + 1 smallest ids can ever be among somebody's k nearest; the others are left out before
anything is shuffled (an exact reduction, also where one vector holds a third of all rows). Neighbouring
leaves share a shelf of about ``BLOCK`` rows, so a query travels once per shelf and not once per
leaf; in there only the leaves that it visits are multiplied. A shelf that is one large leaf is split
into blocks and one that many queries visit into groups; a task meets one block with one group, so
neither ever meets whole, and gives out no more than k rows per query.

Vectors that are null, zero, of another length than most (they have no cosine with the others), or hold
a null or non-finite component take no part, nor do rows without id. Equal rows count once. Rows that
share an id and differ are candidates each and, where the id asks, queries each with ranks of its own
(``query_vector`` tells them apart), but no candidates for each other. Ties go to the smaller id. No
queries: no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslens.llm.common import materialize, table

K, SAMPLE, BRANCH, LEAF, RECALL, CALIBRATION = 5, 20_000, 32, 64, 0.95, 256
BLOCK, GROUP = 4096, 4096
#: Cosines from a matrix product may be off by this much; what comes this close to the k-th is computed again.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Tree:
    """Nodes by number: ``centers`` of a node's children and their numbers; a leaf has none and a place in ``leaf_of``."""

    centers: list[np.ndarray | None]
    children: list[list[int]]
    leaf_of: dict[int, int]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        at, out = [(0, np.arange(len(x)))], np.zeros(len(x), np.int32)
        while at:
            node, rows = at.pop()
            if node in self.leaf_of:
                out[rows] = self.leaf_of[node]
                continue
            nearest = np.argmax(x[rows] @ self.centers[node].T, axis=1)
            at += [(child, own) for i, child in enumerate(self.children[node]) if len(own := rows[nearest == i])]
        return out

    def leaves(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves for one unit vector, best bin first."""
        queue, out = [(-1.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if node in self.leaf_of:
                out.append(self.leaf_of[node])
            else:
                for score, child in zip((self.centers[node] @ q).tolist(), self.children[node], strict=True):
                    heapq.heappush(queue, (-score, child))
        return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centres and each row's. Empty ones go."""
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        length = np.sqrt((sums * sums).sum(axis=1))
        centers = sums[length > 1e-12] / length[length > 1e-12, None]
    return centers, np.argmax(x @ centers.T, axis=1)


def grow(x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 5) -> Tree:
    """A tree over unit vectors; a node of ``leaf`` rows or fewer is a leaf."""
    rng, tree, at = np.random.default_rng(seed), Tree([None], [[]], {}), [(0, np.arange(len(x)))]
    while at:
        node, rows = at.pop()
        if len(rows) > leaf:
            centers, own = kmeans(x[rows], min(branch, len(rows)), rng)
            used = np.unique(own)
            if len(used) > 1:
                tree.centers[node] = centers[used]
                for i in used:
                    tree.children[node].append(len(tree.centers))
                    at.append((len(tree.centers), rows[own == i]))
                    tree.centers.append(None)
                    tree.children.append([])
                continue
        tree.leaf_of[node] = len(tree.leaf_of)
    return tree


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 1)


def usable(vector: Column, dim: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0)


def nearest_in_block(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int, leaf: np.ndarray | None = None, visits: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the row, cosine) of each query's k nearest of a block; with ``visits``, among rows whose ``leaf`` it visits."""
    back = np.arange(len(v))
    if leaf is not None:
        back = np.argsort(leaf, kind="stable")
        v_ids, v, leaf = v_ids[back], v[back], leaf[back]
        present, first = np.unique(leaf, return_index=True)
        ends = np.append(first[1:], len(leaf))
    qu, vu, out = unit(q), unit(v), []
    q_len, v_len = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    for at in range(0, len(q), 128):
        n = min(128, len(q) - at)
        if leaf is None:
            s = qu[at : at + n] @ vu.T
        else:
            s = np.full((n, len(v)), -np.inf)
            seen = np.zeros((n, len(present)), bool)
            for i in range(n):
                seen[i, np.isin(present, visits[at + i])] = True
            for j, (lo, hi) in enumerate(zip(first, ends, strict=True)):
                rows = np.flatnonzero(seen[:, j])
                s[rows, lo:hi] = qu[at + rows] @ vu[lo:hi].T
        s[q_ids[at : at + n, None] == v_ids[None, :]] = -np.inf
        last = np.partition(s, len(v) - min(k, len(v)), axis=1)[:, len(v) - min(k, len(v))]
        i, j = np.nonzero((s >= last[:, None] - SLACK) & (s > -np.inf))
        exact = np.concatenate([np.empty(0), *((q[at + i[x : x + 8192]] * v[j[x : x + 8192]]).sum(axis=1) / (q_len[at + i[x : x + 8192]] * v_len[j[x : x + 8192]]) for x in range(0, len(i), 8192))])
        order = np.lexsort((v_ids[j], -exact, i))  # by query, best first, ties to the smaller id
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        out.append((at + i[keep], back[j[keep]], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (back[:0], back[:0], np.empty(0))


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query_vector").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score, query_vector, a hash of the query's vector): the k nearest found of each row for which ``is_query`` (an expression of the key) holds."""
    spark = rows.sparkSession
    plain = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks")).filter("vec_id is not null")
    common = plain.filter("v is not null and size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_vector long")
    if common is None:
        return empty
    good = materialize(plain.filter(usable(F.col("v"), common["d"])).groupBy("vec_id", "v").agg(F.bool_or("asks").alias("asks")), "vectors")
    same = Window.partitionBy("v").orderBy("vec_id")
    distinct = good.select("vec_id", "v").withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).drop("n")

    sample = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    if not sample.num_rows:
        return empty
    tree = spark.sparkContext.broadcast(grow(unit(matrix(sample.column(0)))))  # bounded by SAMPLE

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.value.assign(unit(matrix(b.column(1)))))], names=["vec_id", "v", "leaf"])

    index = materialize(distinct.mapInArrow(indexed, "vec_id long, v array<double>, leaf int"), "index")
    queries = good.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.xxhash64("v").alias("query_vector"))

    # calibration: exact neighbours of a few queries, and how early their leaves are visited
    trial = queries.orderBy(F.xxhash64("query_id"), "query_id", "query_vector").limit(CALIBRATION).toArrow()
    if not trial.num_rows:
        return empty
    trial_ids, trial_vectors, trial_hashes = trial.column(0).to_numpy(), matrix(trial.column(1)), trial.column(2).to_numpy()
    asked = spark.sparkContext.broadcast((trial_ids, trial_vectors, trial_hashes))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, leaf = b.column(0).to_numpy(), b.column(2).to_numpy()
            i, j, score = nearest_in_block(*asked.value[:2], ids, matrix(b.column(1)), k)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (asked.value[0][i], asked.value[2][i], ids[j], score, leaf[j])], names=["query_id", "query_vector", "vec_id", "score", "leaf"])

    truth = top(index.mapInArrow(exact, "query_id long, query_vector long, vec_id long, score double, leaf int"), k).select("query_vector", "leaf").collect()  # CALIBRATION * k rows
    n_leaves = len(tree.value.leaf_of)
    visit_of = {int(h): {leaf: n for n, leaf in enumerate(tree.value.leaves(q, n_leaves))} for h, q in zip(trial_hashes, unit(trial_vectors), strict=True)}
    needed = sorted(visit_of[r["query_vector"]][r["leaf"]] + 1 for r in truth)
    visits = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else n_leaves

    # neighbouring leaves go on one shelf until it holds BLOCK rows; all that is collected has a row per leaf or shelf
    sizes = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    shelf_of, rows_on = np.zeros(n_leaves, np.int32), [0]
    for leaf in range(n_leaves):
        if rows_on[-1] and rows_on[-1] + sizes.get(leaf, 0) > BLOCK:
            rows_on.append(0)
        shelf_of[leaf] = len(rows_on) - 1
        rows_on[-1] += sizes.get(leaf, 0)
    shelves = spark.sparkContext.broadcast(shelf_of)
    size_of = np.array([sizes.get(leaf, 0) for leaf in range(n_leaves)], np.int64)
    # rows with a query's own id are none of its candidates
    counted = good.filter("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.count("*").alias("own"))

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, shelf, leaves = [], [], []
            own_rows = b.column(3).to_numpy()
            for i, q in enumerate(unit(matrix(b.column(1)))):
                order = tree.value.leaves(q, visits)
                if size_of[order].sum() < k + own_rows[i]:  # leaves that hold too few rows: as many more as it takes
                    order = tree.value.leaves(q, n_leaves)
                    order = order[: max(visits, int(np.searchsorted(np.cumsum(size_of[order]), k + own_rows[i])) + 1)]
                seen = np.sort(np.array(order, np.int32))
                there = shelves.value[seen]
                for own in np.split(np.arange(len(seen)), np.flatnonzero(np.diff(there)) + 1):
                    at.append(i)
                    shelf.append(there[own[0]])
                    leaves.append(seen[own])
            part = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(shelf, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], names=["query_id", "q", "query_vector", "shelf", "leaves"])

    asks = materialize(queries.join(counted, "query_id").select("query_id", "q", "query_vector", "own").mapInArrow(visited, "query_id long, q array<double>, query_vector long, shelf int, leaves array<int>"), "visits")
    loads = {r["shelf"]: r["n"] for r in asks.groupBy("shelf").agg(F.count("*").alias("n")).collect()}
    grid = F.broadcast(spark.createDataFrame([(i, max(1, -(-n // BLOCK)), max(1, -(-loads.get(i, 0) // GROUP))) for i, n in enumerate(rows_on)], "shelf int, blocks int, groups int"))
    place = F.broadcast(spark.createDataFrame([(leaf, int(x)) for leaf, x in enumerate(shelf_of)], "leaf int, shelf int"))

    def spread(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    part = index.join(place, "leaf").join(grid, "shelf").select("shelf", F.pmod(F.xxhash64("vec_id", "v"), "blocks").cast("int").alias("block"), spread("groups").alias("grp"), "leaf", "vec_id", "v")
    ask = asks.join(grid, "shelf").select("shelf", spread("blocks").alias("block"), F.pmod(F.xxhash64("query_id", "query_vector"), "groups").cast("int").alias("grp"), "query_id", "query_vector", "q", "leaves")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, hashes, rows = right["query_id"].to_numpy(), right["query_vector"].to_numpy(), left["vec_id"].to_numpy()
        i, j, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if left.num_rows and right.num_rows:
            i, j, score = nearest_in_block(ids, matrix(right["q"]), rows, matrix(left["v"]), k, left["leaf"].to_numpy(), right["leaves"].to_pylist())
        return pa.table({"query_id": ids[i], "query_vector": hashes[i], "vec_id": rows[j], "score": score})

    by = ["shelf", "block", "grp"]
    found = part.groupBy(*by).cogroup(ask.groupBy(*by)).applyInArrow(meet, "query_id long, query_vector long, vec_id long, score double")
    return top(found, k).select("query_id", "rank", "vec_id", "score", "query_vector")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)
