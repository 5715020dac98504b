"""Prefix scans: a state carried from row to row of a series, for every row, without one task for each series.

A step such as s = a y + (1 - a) s before it, or a Kalman filter's, is an element of an associative
composition. Rows are dealt by ranges of series and day, so a long series lies in many tasks. A task scans
its rows by doubling (vectors of all rows at once, log2 of the longest run many steps), one element for
each task is scanned in a second pass, and what comes before a task's first run is composed with its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.scratch import materialize

#: compose(earlier, later): elements are tuples of numbers, arrays or columns alike.
Compose = Callable[[Sequence, Sequence], Sequence]


def doubled(values: list[np.ndarray], begin: np.ndarray, compose: Compose) -> list[np.ndarray]:
    """Inclusive scan inside each run; ``begin`` is for each row where its run begins."""
    index, width = np.arange(len(begin)), 1
    longest = int((index - begin).max()) + 1 if len(begin) else 0
    while width < longest:
        at = np.flatnonzero(index - width >= begin)
        new = compose([v[at - width] for v in values], [v[at] for v in values])
        values = [v.copy() for v in values]
        for v, x in zip(values, new, strict=True):
            v[at] = x
        width *= 2
    return values


def runs(key: np.ndarray) -> np.ndarray:
    index = np.arange(len(key))
    return np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), index, 0)) if len(key) else index


def prefix_scan(
    df: DataFrame, keys: Sequence[str], day: str, elements: dict[str, Column], compose: Compose, start: Callable[..., Sequence], firsts: Sequence[str], keep: Sequence[str] = (), reverse: bool = False,
) -> DataFrame:
    """``keys``, ``day``, ``keep`` and for each row the composition of the start with all elements up to it, under the elements' names.

    ``start`` gives the element before a series from its first row's ``firsts``. ``reverse`` goes from the last day back.
    Days have to be distinct in a series. Series are told apart by a 64-bit hash of their keys.
    """
    names, order = list(elements), F.desc(day) if reverse else F.asc(day)
    held = list(dict.fromkeys([*keep, *firsts]))
    rows = df.select(*keys, day, *held, *[c.cast("double").alias(n) for n, c in elements.items()]).withColumn("s_key", F.xxhash64(*keys))
    dealt = rows.repartitionByRange("s_key", order).sortWithinPartitions("s_key", order)
    dealt = dealt.select("s_key", F.spark_partition_id().cast("long").alias("s_part"), *keys, day, *held, *names, *[F.col(c).cast("double").alias(f"f_{c}") for c in firsts], F.lit(False).alias("s_tail"))
    fields, kind = dealt.columns, dealt.schema
    width, at = len(fields), {c: i for i, c in enumerate(fields)}
    moving = [*names, *[f"f_{c}" for c in firsts]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ready = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            begin = runs(key)
            values = doubled([batch.column(at[n]).to_numpy(zero_copy_only=False).copy() for n in names], begin, compose)
            first = [batch.column(at[f"f_{c}"]).to_numpy(zero_copy_only=False)[begin] for c in firsts]
            if last is not None and last[0] == key[0]:
                goes_on = begin == 0
                for v, x in zip(values, compose(last[1], [v[goes_on] for v in values]), strict=True):
                    v[goes_on] = x
                for v, x in zip(first, last[2], strict=True):
                    v[goes_on] = x
            last = (key[-1], [v[-1] for v in values], [v[-1] for v in first])
            if ready is not None:
                yield ready
            columns = list(batch.columns)
            for n, v in zip(moving, [*values, *first], strict=True):
                columns[at[n]] = pa.array(v)
            ready = pa.RecordBatch.from_arrays(columns, names=fields)
        if ready is not None:
            tail = np.arange(ready.num_rows) == ready.num_rows - 1
            yield pa.RecordBatch.from_arrays([*ready.columns[: width - 1], pa.array(tail)], names=fields)

    local = materialize(dealt.mapInArrow(run, kind), "scan")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            tails = pa.Table.from_batches(found)  # a row for each task of the first pass
            column = lambda n: tails.column(n).to_numpy()
            key, part = column("s_key"), column("s_part")
            begin = runs(key)
            values = doubled([column(n).copy() for n in names], begin, compose)
            whole = compose([np.broadcast_to(x, key.shape) for x in start(*[column(f"f_{c}")[begin] for c in firsts])], values)
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1]), pa.array(part[1:]), *[pa.array(np.asarray(v, float)[:-1]) for v in whole]], names=["s_key", "s_part", *[f"c_{n}" for n in names]])

    tails = local.filter("s_tail").select("s_key", "s_part", *moving).coalesce(1).sortWithinPartitions("s_part")
    carried = tails.mapInArrow(carry, "s_key long, s_part long, " + ", ".join(f"c_{n} double" for n in names))
    met = local.join(F.broadcast(carried), ["s_key", "s_part"], "left")  # at most a row for each task
    before = [F.when(F.col(f"c_{n}").isNotNull(), F.col(f"c_{n}")).otherwise(s if isinstance(s, Column) else F.lit(float(s))) for n, s in zip(names, start(*[F.col(f"f_{c}") for c in firsts]), strict=True)]
    state = compose(before, [F.col(n) for n in names])
    return met.select(*keys, day, *keep, *[c.alias(n) for n, c in zip(names, state, strict=True)])


def affine(earlier: Sequence, later: Sequence) -> Sequence:
    """s -> a s + b, one after the other."""
    (a1, b1), (a2, b2) = earlier, later
    return a2 * a1, a2 * b1 + b2


def with_value(df: DataFrame, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def exp_smooth_series(df: DataFrame, keys: Sequence[str], value: str, a: float, day: str = "date") -> DataFrame:
    """keys, day, value, smoothed: s = a y + (1 - a) s before it on every day, from the first value on. Rows without a value are left out."""
    known = with_value(df, value)
    out = prefix_scan(known, keys, day, {"s_a": F.lit(1 - a), "smoothed": a * F.col(value)}, affine, lambda y: (0.0, y), [value], [value])
    return out.drop("s_a")


def filtering(earlier: Sequence, later: Sequence) -> Sequence:
    """Elements of a scalar linear filter: gain a, mean b and variance c of the state, and what they would have made likely before (h, j)."""
    (a1, b1, c1, h1, j1), (a2, b2, c2, h2, j2) = earlier, later
    d = 1 + c1 * j2
    return a2 * a1 / d, a2 * (b1 + c1 * h2) / d + b2, a2 * a2 * c1 / d + c2, a1 * (h2 - j2 * b1) / d + h1, a1 * a1 * j2 / d + j1


def smoothing(earlier: Sequence, later: Sequence) -> Sequence:
    """Elements of the backward pass: mean e m + g and variance e e p + l, m and p being those of the day after."""
    (e1, g1, l1), (e2, g2, l2) = earlier, later
    return e2 * e1, e2 * g1 + g2, e2 * e2 * l1 + l2


DIFFUSE = 1e18


def kalman_series(df: DataFrame, keys: Sequence[str], value: str, q: float, r: float, day: str = "date") -> DataFrame:
    """keys, day, level, variance, smoothed, smoothed_variance of a local level on every day with a value.

    The level moves with variance ``q`` from row to row and is seen with variance ``r``; before the first value nothing is known.
    """
    s, y = q + r, F.col(value)
    k = q / s
    steps = {"k_a": F.lit(1 - k), "level": k * y, "variance": F.lit((1 - k) * q), "k_h": y / s, "k_j": F.lit(1 / s)}
    seen = prefix_scan(with_value(df, value), keys, day, steps, filtering, lambda y: (0.0, y, DIFFUSE, 0.0, 0.0), [value], [value])
    seen = materialize(seen.select(*keys, day, "level", "variance"), "kalman")
    e = F.col("variance") / (F.col("variance") + q)
    back = {"b_e": e, "smoothed": (1 - e) * F.col("level"), "smoothed_variance": F.col("variance") - e * e * (F.col("variance") + q)}
    out = prefix_scan(seen, keys, day, back, smoothing, lambda m, p: (0.0, m, p + q), ["level", "variance"], ["level", "variance"], reverse=True)
    return out.drop("b_e")
