"""Principal components of trailing windows: second moments by month, added up by window, and a small eigenproblem each."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_moments(df: DataFrame, xs: Sequence[str], months: int, keys: Sequence[str] = (), day: str = "date") -> DataFrame:
    """(keys, month, n, s0.., m0_0..): sums over the months up to and with each month that has rows. Rows with a null are left out.

    Rows meet in one aggregation by month; windows add up a few rows of it.
    """
    v = [F.col(x).cast("double") for x in xs]
    pairs = list(combinations_with_replacement(range(len(xs)), 2))
    sums = {"n": F.count(F.lit(1)).cast("double")} | {f"s{i}": F.sum(c) for i, c in enumerate(v)} | {f"m{i}_{j}": F.sum(v[i] * v[j]) for i, j in pairs}
    monthly = df.dropna(subset=list(xs)).groupBy(*keys, F.trunc(day, "month").alias("month")).agg(*[c.alias(n) for n, c in sums.items()])
    number = F.year("month") * 12 + F.month("month")
    w = Window.partitionBy(*keys).orderBy(number).rangeBetween(-(months - 1), 0)
    return monthly.select(*keys, "month", *[F.sum(n).over(w).alias(n) for n in sums])


def window_components(df: DataFrame, xs: Sequence[str], months: int, k: int = 2, keys: Sequence[str] = (), day: str = "date", least: int = 10) -> DataFrame:
    """(keys, month, component, n, share, loadings): components of each window's covariance, the largest first.

    ``loadings`` is an array in the order of ``xs``, of length 1. Its sign is that which points along the same component one
    window before; in the first window the largest loading is positive. Windows with fewer than ``least`` rows, or without
    any variance, give no row.
    """
    p, pairs = len(xs), list(combinations_with_replacement(range(len(xs)), 2))
    cov = [(F.col(f"m{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) / (F.col("n") - 1) for i, j in pairs]
    rows = window_moments(df, xs, months, keys, day).filter(F.col("n") >= max(least, 2)).select(*keys, "month", F.col("n").cast("long").alias("n"), F.array(*cov).alias("cov"))
    named = [*keys, "month", "n"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(len(named)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            matrix = np.zeros((batch.num_rows, p, p))
            for c, (i, j) in enumerate(pairs):
                matrix[:, i, j] = matrix[:, j, i] = flat[:, c]
            values, vectors = np.linalg.eigh(matrix)
            values, vectors = np.maximum(values[:, ::-1], 0), vectors[:, :, ::-1]
            total = values.sum(axis=1)
            row = np.repeat(np.flatnonzero(total > 0), k)
            component = np.tile(np.arange(k), int((total > 0).sum()))
            loading = vectors[row, :, component]
            lead = np.take_along_axis(loading, np.abs(loading).argmax(axis=1)[:, None], axis=1)
            loading = loading * np.where(lead < 0, -1.0, 1.0)
            offsets = pa.array(np.arange(0, len(row) * p + 1, p, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(pa.array(row)) for i in range(len(named))], pa.array(component.astype(np.int32)), pa.array(values[row, component] / total[row]), pa.ListArray.from_arrays(offsets, pa.array(loading.ravel()))],
                names=[*named, "component", "share", "loadings"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*named).schema.fields)
    found = rows.mapInArrow(solve, f"{kinds}, component int, share double, loadings array<double>")
    w = Window.partitionBy(*keys, "component").orderBy("month")
    along = F.aggregate(F.zip_with("loadings", F.lag("loadings").over(w), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    turns = found.withColumn("turn", F.when(along < 0, 1).otherwise(0))
    sign = F.when(F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1, -1.0).otherwise(1.0)
    return turns.withColumn("sign", sign).select(*keys, "month", "component", "n", "share", F.transform("loadings", lambda x: x * F.col("sign")).alias("loadings"))
