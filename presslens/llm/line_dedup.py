"""Line dedup by pairwise alignment: common blocks of lines go from the later of two documents.

From each line on, and back from each line, the shortest run of lines that reaches ``BLOCK_WORDS``
words leads its documents to the first one that holds it: links grow with the lines, not with the
square of a run's holders, so rare lines and very common ones need no different treatment (rarity only
bounds the pairs in the plain form of the method), and every block of so many words is made of such runs. Each linked pair is aligned on arrays of line
hashes, patience-wise: the lines that both hold are put in the longest order that both share, and runs
of neighbours become blocks. Blocks of ``BLOCK_WORDS`` words or more go from the later document. Where a
shared line is repeated, or stands outside that order, so does every run of so many words that stands
anywhere in the earlier document; those are found by a suffix automaton, not by aligning again, in
proportion to the lines.

A line's first holder never loses it, so no line vanishes from the corpus. Lines are what stands
between newlines; those without a word are no evidence, and go only from inside a block. Lines are
compared by their 64-bit hash, runs of lines by one made of those.

A null text stays null and holds no line. Documents are ordered by doc_id, those without one last, and
by the hash of their text where that is the same; rows equal in both are one document and end up
equal. A document that loses every line keeps its row, with an empty text. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm.common import WORD, materialize, table, workspace

BLOCK_WORDS = 5
LAST = 2**63 - 1
BASE = np.uint64(0x9E3779B97F4A7C17)


def rising(values: Sequence[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(left: Sequence[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Of (line of the later, line of the earlier document): runs of neighbours in the longest order that both share, and what is left."""
    chosen = [left[k] for k in rising([i for _, i in left])]
    blocks, start = [], 0
    for k in range(1, len(chosen) + 1):
        if k == len(chosen) or chosen[k][0] != chosen[k - 1][0] + 1 or chosen[k][1] != chosen[k - 1][1] + 1:
            blocks.append((chosen[start][0], chosen[k - 1][0] + 1))
            start = k
    gone = set(chosen)
    return blocks, [x for x in left if x not in gone]


def first_places(earlier: Sequence[int], later: Sequence[int]) -> list[tuple[int, int]]:
    """(line of ``later``, line of ``earlier``) of each shared line, where each document first has it."""
    place: dict[int, int] = {}
    for i, h in enumerate(earlier):
        place.setdefault(h, i)
    seen: set[int] = set()
    return [(j, place[h]) for j, h in enumerate(later) if h in place and not (h in seen or seen.add(h))]


def common_blocks(earlier: Sequence[int], later: Sequence[int]) -> list[tuple[int, int]]:
    """Runs (start, end) of lines of ``later`` that stand together in ``earlier`` too, by alignments until nothing is left.

    A line counts where each document first has it.
    """
    left, blocks = first_places(earlier, later), []
    while left:
        found, left = aligned(left)
        blocks += found
    return sorted(blocks)


def matched(earlier: Sequence[int], later: Sequence[int]) -> list[int]:
    """For each line of ``later``, how many lines up to and with it stand in a row anywhere in ``earlier``: the most there are.

    By a suffix automaton of ``earlier``, in proportion to the lines of both however often they repeat.
    """
    steps: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for h in earlier:
        new = len(steps)
        steps.append({})
        link.append(0)
        size.append(size[last] + 1)
        at, last = last, new
        while at >= 0 and h not in steps[at]:
            steps[at][h] = new
            at = link[at]
        if at < 0:
            continue
        to = steps[at][h]
        if size[to] > size[at] + 1:
            twin = len(steps)
            steps.append(dict(steps[to]))
            link.append(link[to])
            size.append(size[at] + 1)
            link[to] = twin
            while at >= 0 and steps[at].get(h) == to:
                steps[at][h] = twin
                at = link[at]
            to = twin
        link[new] = to
    out, at, run = [], 0, 0
    for h in later:
        while at and h not in steps[at]:
            at = link[at]
            run = size[at]
        if h in steps[at]:
            at, run = steps[at][h], run + 1
        out.append(run)
    return out


def doomed(earlier: Sequence[int], later: Sequence[int], words: Sequence[int], least: int = BLOCK_WORDS) -> list[int]:
    """Lines of ``later`` to delete: those of every long enough run that stands anywhere in ``earlier``.

    One alignment finds all such runs if it takes in every shared line and none is repeated. Else lines
    have moved, which would take an alignment for each, and the automaton finds the runs in one pass.
    """
    out: set[int] = set()
    blocks, moved = aligned(first_places(earlier, later))
    for a, b in blocks:
        if sum(words[a:b]) >= least:
            out.update(range(a, b))
    shared = set(earlier).intersection(later)
    if moved or any(sum(h in shared for h in x) > len(shared) for x in (earlier, later)):
        sums, done = [0, *accumulate(words)], 0
        for j, run in enumerate(matched([h if h in shared else None for h in earlier], later)):
            if sums[j + 1] - sums[j + 1 - run] >= least:
                out.update(range(max(done, j + 1 - run), j + 1))
                done = j + 1
    return sorted(out)


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per row: its place in the order, its text's hash, and hash, word count and position of each line with a word."""
    lines = F.filter(
        F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w"), i.alias("p"))),
        lambda s: s["w"] > 0,
    )
    split = docs.select(F.coalesce(F.col(key), F.lit(LAST)).alias("at"), F.xxhash64(text).alias("th"), lines.alias("lines"))
    return split.select("at", "th", F.col("lines.h").alias("h"), F.col("lines.w").alias("w"), F.col("lines.p").alias("p"))


def run_hashes(h: np.ndarray, w: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of the shortest runs of lines that reach ``least`` words: from each line on and back from each line.

    ``ends`` is for each line the end of its document. Together these runs cover each block of ``least`` words or more.
    """
    n = len(h)
    sums = np.concatenate([[0], np.cumsum(w)])
    at = np.arange(n)
    stop = np.searchsorted(sums, sums[:-1] + least)  # lines at .. stop - 1
    begin = np.searchsorted(sums, sums[1:] - least, side="right") - 1  # lines begin .. at
    whole = stop <= ends
    back = np.flatnonzero(begin >= 0)
    back = back[ends[begin[back]] == ends[back]]
    back = back[stop[begin[back]] != back + 1]  # the others are there already
    first, after = np.concatenate([at[whole], begin[back]]), np.concatenate([stop[whole], back + 1])
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64))])
    inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, pow(int(BASE), -1, 2**64), np.uint64))])
    rolled = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h.view(np.uint64) * powers[:-1])])
    return first, ((rolled[after] - rolled[first]) * inverse[first]).view(np.int64)


def runs(lines: DataFrame, least: int) -> DataFrame:
    """(at, th, h): hashes of the shortest runs of each document's lines that reach ``least`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, th, h, w = batch.columns
            sizes = h.value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            first, found = run_hashes(h.flatten().to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)[doc], least)
            holder = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays([at.take(holder), th.take(holder), pa.array(found)], names=["at", "th", "h"])

    return lines.select("at", "th", "h", "w").mapInArrow(run, "at long, th long, h long")


def linked(lines: DataFrame, least: int = BLOCK_WORDS) -> DataFrame:
    """(at, th, f_at, f_th): each document with every document that first holds one of its shortest long enough runs of lines."""
    each = runs(lines, least).select("h", F.struct("at", "th").alias("doc"))
    firsts = materialize(each.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select(F.col("h").alias("fh"), "first"), "run-firsts")
    return each.join(firsts, F.col("h") == F.col("fh")).filter("first < doc").select("doc.at", "doc.th", F.col("first.at").alias("f_at"), F.col("first.th").alias("f_th")).distinct()


def deletions(lines: DataFrame, least: int = BLOCK_WORDS) -> DataFrame:
    """(d_at, d_th, gone): positions of the lines that a document loses. ``lines`` has one row per document."""
    pairs = linked(lines, least)
    early = lines.select(F.col("at").alias("e_at"), F.col("th").alias("e_th"), F.col("h").alias("e_h"))
    late = lines.select(F.col("at").alias("l_at"), F.col("th").alias("l_th"), F.col("h").alias("l_h"), F.col("w").alias("l_w"), F.col("p").alias("l_p"))
    met = pairs.join(early, (F.col("f_at") == F.col("e_at")) & (F.col("f_th") == F.col("e_th")))
    both = met.join(late, (F.col("at") == F.col("l_at")) & (F.col("th") == F.col("l_th"))).select("l_at", "l_th", "e_h", "l_h", "l_w", "l_p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for row in range(batch.num_rows):
                e, h, w, p = (batch.column(c)[row].values.to_pylist() for c in (2, 3, 4, 5))
                gone.append([p[j] for j in doomed(e, h, w, least)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], names=["d_at", "d_th", "gone"])

    found = both.mapInArrow(run, "d_at long, d_th long, gone array<int>").filter(F.size("gone") > 0)
    return found.groupBy("d_at", "d_th").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the texts that are left, and ``lines_gone``: positions (from 0) of the lines that went."""
    columns = [c for c in docs.columns if c != "lines_gone"]
    with workspace(docs.sparkSession) as work:
        # rows that are equal in doc_id and text are one document
        one = line_table(docs, key, text).groupBy("at", "th").agg(F.any_value(F.struct("h", "w", "p")).alias("lines")).select("at", "th", "lines.*")
        gone = materialize(deletions(work.keep(one, "lines"), least), "lines-gone")
    row = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col(key), F.lit(LAST)).alias("at"), F.xxhash64(text).alias("th"))
    joined = row.join(gone, (F.col("at") == F.col("d_at")) & (F.col("th") == F.col("d_th")), "left")
    parts = joined.withColumn("parts", F.when(F.col("gone").isNotNull(), F.split(F.col(f"row.{text}"), "\n")))
    # array_except() takes each position once, in order: with it a filter by membership costs no search per line
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    left = F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n")
    new = F.when(F.col("gone").isNull(), F.col(f"row.{text}")).otherwise(left)
    return parts.select(*[new.alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in columns], F.sort_array(F.coalesce("gone", F.array().cast("array<int>"))).alias("lines_gone"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
