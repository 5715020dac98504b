"""Stored Gold: daily and windowed tables by month, in versions that a snapshot names and readers pin.

A refresh computes only what the touched dates reach: their own daily rows, and the windows of every date
whose sums or baseline read them. Months that hold such dates are written anew under the next version;
nothing that an older snapshot names is changed. Events are made once for a refresh, with the columns that
its tables read: what they are joined from is not joined anew by each aggregate. A snapshot is a small table of (table, month, version),
there once it is written whole, so that a reader sees all of a refresh or nothing of it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.config import DEFAULT, Config
from presslens.operators import gold
from presslens.scratch import exists, remove, workspace


@dataclass(frozen=True)
class Layer:
    """A daily table, made of the events of its date alone, the windowed one that is made of it, and the columns of events that they need."""

    name: str
    reads: tuple[str, ...]
    daily: Callable[[DataFrame], DataFrame]
    windows: Callable[[DataFrame], DataFrame]


READS = (*gold.EDGE, "num_mentions", "num_sources", "avg_tone", "goldstein")
PAIRS = Layer("pair", (*READS, "source_domain"), gold.pair_daily, gold.pair_windows)
STATES = Layer("state", READS, gold.state_daily, gold.state_windows)


def reach(cfg: Config = DEFAULT) -> int:
    """How many days after a date the last window or baseline reads it: a sum inside the seasonal frame of the last day."""
    return cfg.lookback_days + max(cfg.windows) - 1


def frontier(touched: DataFrame, cfg: Config = DEFAULT, day: str = "date") -> DataFrame:
    """(date, reads): dates whose rows change with ``touched``: 'daily' itself, 'window' by a sum, 'baseline' by a seasonal frame; the nearest counts."""
    window = max(cfg.windows) - 1
    far = touched.select(F.col(day).alias("t")).distinct().withColumn("after", F.explode(F.sequence(F.lit(0), F.lit(reach(cfg)))))
    reads = F.when(F.col("after") == 0, 0).when(F.col("after") <= window, 1).when(F.col("after") >= cfg.gap_days, 2)
    nearest = far.withColumn("kind", reads).filter("kind is not null").groupBy(F.date_add("t", F.col("after")).alias("date")).agg(F.min("kind").alias("kind"))
    return nearest.select("date", F.element_at(F.array(*map(F.lit, ["daily", "window", "baseline"])), F.col("kind") + 1).alias("reads"))


def months_between(start: date, end: date) -> list[date]:
    first, last = start.year * 12 + start.month - 1, end.year * 12 + end.month - 1
    return [date(m // 12, m % 12 + 1, 1) for m in range(first, last + 1)]


class GoldStore:
    """Tables {layer}_day and {layer}_window under ``root``. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str, layers: Sequence[Layer] = (PAIRS, STATES), cfg: Config = DEFAULT) -> None:
        self.spark, self.root, self.layers, self.cfg = spark, root, layers, cfg

    def latest(self) -> int:
        """Number of the newest whole snapshot; 0 before the first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_snapshots/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return max((int(f.getPath().getParent().getName()) for f in found), default=0)

    def manifest(self, snapshot: int) -> dict[str, dict[date, int]]:
        """By table, the version of each month: a row a month, as many as the calendar has."""
        out: dict[str, dict[date, int]] = {}
        if snapshot:
            for r in self.spark.read.parquet(f"{self.root}/_snapshots/{snapshot}").collect():
                out.setdefault(r["table"], {})[r["month"]] = r["version"]
        return out

    def _paths(self, name: str, versions: dict[date, int], months: Sequence[date] | None = None) -> list[str]:
        return [f"{self.root}/{name}/month={m}/version={v}" for m, v in sorted(versions.items()) if months is None or m in set(months)]

    def _load(self, name: str, paths: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths)

    def read(self, name: str, start: str | None = None, end: str | None = None, snapshot: int | None = None) -> DataFrame:
        """A table's rows of some days, as one snapshot has them (the newest, if none is named). Only the partitions of their months are listed and read."""
        versions = self.manifest(snapshot or self.latest()).get(name, {})
        if not versions:
            raise ValueError(f"{name} isn't stored under {self.root}")
        lo, hi = date.fromisoformat(start) if start else min(versions), date.fromisoformat(end) if end else date(9999, 12, 1)
        chosen = self._paths(name, versions, months_between(lo, min(hi, max(versions)))) or self._paths(name, versions)[:1]
        found = self._load(name, chosen).filter(F.col("month") >= F.lit(lo.replace(day=1)))
        if start:
            found = found.filter(F.col("date") >= F.lit(lo))
        if end:
            found = found.filter((F.col("month") <= F.lit(hi)) & (F.col("date") <= F.lit(hi)))
        return found.drop("month", "version")

    def _write(self, df: DataFrame, name: str, version: int) -> list[date]:
        """New months of a table; which of them have rows."""
        out = f"{self.root}/{name}"
        placed = df.withColumns({"month": F.trunc("date", "month"), "version": F.lit(version)}).repartition("month")
        placed.write.mode("append").partitionBy("month", "version").parquet(out)
        return [m for m in self._written(name, version)]

    def _written(self, name: str, version: int) -> list[date]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/month=*/version={version}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return [date.fromisoformat(f.getPath().getParent().getName().removeprefix("month=")) for f in found]

    def refresh(self, events: DataFrame, touched: DataFrame | None = None) -> int:
        """Publish the snapshot after ``events``, all of them as they are now. ``touched`` (date) names the dates that differ
        from the last snapshot; without it, or before the first snapshot, everything is made. The new snapshot's number."""
        last = self.latest()
        version, known = last + 1, self.manifest(last)
        for name in [t for layer in self.layers for t in (f"{layer.name}_day", f"{layer.name}_window")]:
            for m in self._written(name, version):  # what a refresh that failed has left
                remove(self.spark, f"{self.root}/{name}/month={m}/version={version}")
        new: list[tuple[str, date, int]] = []
        whole = touched is None or not last
        dates = [] if whole else [r["date"] for r in touched.select("date").distinct().collect()]  # bounded by the calendar
        own = sorted({d.replace(day=1) for d in dates})
        hit = sorted({m for d in dates for m in months_between(d, date.fromordinal(d.toordinal() + reach(self.cfg)))})
        with workspace(self.spark) as work:
            names = sorted({c for layer in self.layers for c in layer.reads})
            own_events = work.keep((events if whole else events.filter(F.col("event_date").isin(dates))).select(*names), "events")
            for layer in self.layers:
                day, window = f"{layer.name}_day", f"{layer.name}_window"
                days, windows = dict(known.get(day, {})), dict(known.get(window, {}))
                fresh, keep = layer.daily(own_events), None
                if not whole:
                    old = self._paths(day, days, own)
                    keep = self._load(day, old).filter(~F.col("date").isin(dates)).drop("month", "version") if old else None
                made = self._write(fresh if keep is None else fresh.unionByName(keep), day, version)
                days = {m: v for m, v in days.items() if not whole and m not in own} | dict.fromkeys(made, version)
                if whole:
                    needed = self._paths(day, days)
                else:
                    before = {m for d in hit for m in months_between(date.fromordinal(d.toordinal() - reach(self.cfg)), d)}
                    needed = self._paths(day, days, sorted(before))
                made = []
                if needed:
                    rolled = layer.windows(self._load(day, needed).drop("month", "version"))
                    made = self._write(rolled if whole else rolled.filter(F.trunc("date", "month").isin(hit)), window, version)
                windows = {m: v for m, v in windows.items() if not whole and m not in hit} | dict.fromkeys(made, version)
                new += [(t, m, v) for t, vs in ((day, days), (window, windows)) for m, v in vs.items()]
        self.spark.createDataFrame(new, "table string, month date, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/_snapshots/{version}")
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Remove what only snapshots before the newest ``keep`` name. Readers that pinned an older one lose it."""
        last = self.latest()
        held = {(t, m, v) for n in range(max(1, last - keep + 1), last + 1) for t, ms in self.manifest(n).items() for m, v in ms.items()}
        for n in range(1, last - keep + 1):
            if exists(self.spark, f"{self.root}/_snapshots/{n}"):
                for t, ms in self.manifest(n).items():
                    for m, v in ms.items():
                        if (t, m, v) not in held:
                            remove(self.spark, f"{self.root}/{t}/month={m}/version={v}")
                remove(self.spark, f"{self.root}/_snapshots/{n}")
