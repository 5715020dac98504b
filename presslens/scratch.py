"""Scratch tables: they cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of our own, by application: only local sessions that name none have one.
_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. A local session without it gets a temporary folder; a cluster has to set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="spark-presslens-")
    return _LOCAL[context.applicationId]


def own_dir(spark: SparkSession) -> str:
    """Everything that this application writes as scratch lies under it."""
    return f"{scratch_dir(spark)}/presslens/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str, under: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back: what was computed outlives the executors that computed it."""
    path = f"{under or own_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """Scratch tables that are of use to one computation only."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, f"{own_dir(spark)}/work-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        return materialize(df, label, self.path)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Workspace]:
    """Tables kept in it are gone at its end: write what is to stay before that."""
    work = Workspace(spark)
    try:
        yield work
    finally:
        remove(spark, work.path)


def clear(spark: SparkSession) -> None:
    """Remove all scratch of this application, at the end of a job: results that haven't been written by then are lost."""
    remove(spark, own_dir(spark))
