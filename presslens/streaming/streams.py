"""The incremental path as Structured Streaming: sources, windows, state, sinks.

Every stream here ends by itself (``availableNow``) and can be started again from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from presslens.functions.weights import tau
from presslens.scratch import exists


def stream_files(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files, each once per checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_time(events: DataFrame, late: str) -> DataFrame:
    """``ts`` as a timestamp with a watermark, which plain date-times can't have."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def stream_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 day", by: str = "event_type") -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = with_time(events, late).groupBy(w, by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), by, "n", "total")


def stream_dedupe(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return with_time(events, late).dropDuplicatesWithinWatermark(keys)


def stream_enrich(events: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """A stream beside a table; a small table is broadcast when Spark finds it small."""
    return events.join(static, key, "left")


def stream_sessions(events: DataFrame, gap: str = "6 hours", by: str = "user_id", late: str = "1 day") -> DataFrame:
    grouped = with_time(events, late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def stream_join(events: DataFrame, mentions: DataFrame, within: str, late: str = "1 hour") -> DataFrame:
    """Events with the mentions of them that come within a time: state on both sides is let go by the watermarks."""
    left = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    right = mentions.withColumn("mention_ts", F.col("mention_ts").cast("timestamp")).withWatermark("mention_ts", late)
    timely = (F.col("mention_ts") >= F.col("ts")) & (F.col("mention_ts") <= F.col("ts") + F.expr(f"interval {within}"))
    return left.join(right, (left["event_id"] == right["of_event_id"]) & timely)


class Decayed(StatefulProcessor):
    """A running sum per key that halves with time, kept in the state store: one small row per key."""

    def __init__(self, half_life_days: float) -> None:
        self.scale = tau(half_life_days) * 86_400

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("level", T.StructType([T.StructField("at", T.DoubleType()), T.StructField("level", T.DoubleType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at, level = self.state.get() if self.state.exists() else (None, 0.0)
        for part in rows:
            if len(part):  # what is left of every value, and of the level, at the last time of all
                last = part["at"].max() if at is None else max(at, part["at"].max())
                left = 0.0 if at is None else level * np.exp((at - last) / self.scale)
                at, level = float(last), float(left + (part["value"] * np.exp((part["at"] - last) / self.scale)).sum())
        self.state.update((at, level))
        yield pd.DataFrame({"key": [key[0]], "at": [at], "level": [level]})

    def close(self) -> None:
        pass


def stream_decay(events: DataFrame, key: str, half_life_days: float = 14.0) -> DataFrame:
    """(key, at, level) whenever a key's level changes. Needs the RocksDB state store."""
    plain = events.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("at"), F.col("value").cast("double").alias("value"))
    return plain.groupBy("key").transformWithStateInPandas(Decayed(half_life_days), "key string, at double, level double", "Update", "None")


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run what is there to its end into Parquet under ``path``, and read it.

    A batch that is run again replaces what it wrote. In complete mode the last batch is the whole result.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/all" if mode == "complete" else f"{path}/batch={number}")

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = df.sparkSession
    if not exists(spark, path):  # nothing came
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{path}/all" if mode == "complete" else f"{path}/batch=*")


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> None:
    df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_dates(df: DataFrame, path: str, checkpoint: str, keys: list[str], aggs: list[Column], day: str = "date") -> None:
    """Rebuild the dates that a batch touches: its rows go to those dates' Silver, and their Gold is written anew.

    Silver is partitioned by date and batch, so a batch that is run again replaces its own rows. Only the
    touched dates are read back; their number is bounded by the calendar.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch_number", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, "batch_number").parquet(f"{path}/silver")
        touched = [r[0] for r in batch.select(day).distinct().collect()]
        if touched:
            fresh = spark.read.parquet(f"{path}/silver").filter(F.col(day).isin(touched)).drop("batch_number").groupBy(day, *keys).agg(*aggs)
            fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(f"{path}/gold")

    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def corrected(spark: SparkSession, path: str, part: str) -> DataFrame:
    """``gold`` or ``corrections`` under ``path``, without the columns that only place files."""
    return spark.read.parquet(f"{path}/{part}").drop("batch_number")


def stream_corrected(df: DataFrame, path: str, checkpoint: str, keys: list[str], aggs: dict[str, Column], late: str, day: str = "date", ts: str = "ts") -> None:
    """Gold by day that late rows correct, where a windowed stream would drop them.

    A row is late if its ``ts`` lies more than ``late`` before the last one of all earlier batches. Rows in
    time go to ``silver``, late ones to the side table ``late``; either way Gold of the days that a batch
    touches is written anew from both. What late rows change is also written to ``corrections``: each group
    as it was, with ``sign`` -1, and as it is, with 1, so that who keeps sums of Gold elsewhere adds sign
    times value. Rows without a time are never late; rows without a day form a day of their own (null).

    A batch that runs again replaces its own files: what was before it is read by batch number. Only the
    touched days are read back; their number is bounded by the calendar.
    """

    def store(rows: DataFrame, name: str, number: int, by: str = day) -> None:
        placed = rows.withColumn("batch_number", F.lit(number))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by, "batch_number").parquet(f"{path}/{name}")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            seen = None
            if exists(spark, f"{path}/seen"):
                seen = spark.read.parquet(f"{path}/seen").filter(F.col("batch_number") < number).agg(F.max("last")).first()[0]
            behind = F.lit(False) if seen is None else F.coalesce(F.col(ts) < F.lit(seen) - F.expr(f"interval {late}"), F.lit(False))
            touched = [r[0] for r in batch.select(day).distinct().collect()]
            if not touched:
                return
            store(batch.filter(~behind), "silver", number)
            store(batch.filter(behind), "late", number)
            batch.agg(F.max(ts).alias("last")).withColumn("batch_number", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_number").parquet(f"{path}/seen")
            here = F.col(day).isin([x for x in touched if x is not None])
            here = here | F.col(day).isNull() if None in touched else here
            placed = T.StructType([*batch.schema.fields, T.StructField("batch_number", T.IntegerType())])
            read = lambda name: spark.read.schema(placed).parquet(f"{path}/{name}").filter(here & (F.col("batch_number") <= number))
            rows = read("silver").withColumn("is_new", F.lit(False)).unionByName(read("late").withColumn("is_new", F.col("batch_number") == number))
            total = lambda part: part.groupBy(day, *keys).agg(*[c.alias(name) for name, c in aggs.items()])
            changed = batch.filter(behind).select(day, *keys).distinct()
            same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (day, *keys)]
            signed = total(rows.filter("not is_new")).withColumn("sign", F.lit(-1)).unionByName(total(rows).withColumn("sign", F.lit(1)))
            store(signed.alias("a").join(changed.alias("b"), same, "left_semi"), "corrections", number)
            total(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(f"{path}/gold")
        finally:
            batch.unpersist()

    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
