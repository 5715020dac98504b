"""A session with what the library relies on; on a cluster, pass your own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", name: str = "presslens") -> SparkSession:
    spark = (
        SparkSession.builder.master(master).appName(name)
        .config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
