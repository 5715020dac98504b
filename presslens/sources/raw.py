"""Raw files in, layers out: slices of events, mentions and themes; lineage, manifests, retention."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a raw event line, in order.
EVENT_COLUMNS = [
    "GlobalEventID", "SQLDATE", "MonthYear", "Year", "FractionDate",
    "Actor1Code", "Actor1Name", "Actor1CountryCode", "Actor1KnownGroupCode", "Actor1EthnicCode", "Actor1Religion1Code", "Actor1Religion2Code", "Actor1Type1Code", "Actor1Type2Code", "Actor1Type3Code",
    "Actor2Code", "Actor2Name", "Actor2CountryCode", "Actor2KnownGroupCode", "Actor2EthnicCode", "Actor2Religion1Code", "Actor2Religion2Code", "Actor2Type1Code", "Actor2Type2Code", "Actor2Type3Code",
    "IsRootEvent", "EventCode", "EventBaseCode", "EventRootCode", "QuadClass", "GoldsteinScale", "NumMentions", "NumSources", "NumArticles", "AvgTone",
    "Actor1Geo_Type", "Actor1Geo_FullName", "Actor1Geo_CountryCode", "Actor1Geo_ADM1Code", "Actor1Geo_ADM2Code", "Actor1Geo_Lat", "Actor1Geo_Long", "Actor1Geo_FeatureID",
    "Actor2Geo_Type", "Actor2Geo_FullName", "Actor2Geo_CountryCode", "Actor2Geo_ADM1Code", "Actor2Geo_ADM2Code", "Actor2Geo_Lat", "Actor2Geo_Long", "Actor2Geo_FeatureID",
    "ActionGeo_Type", "ActionGeo_FullName", "ActionGeo_CountryCode", "ActionGeo_ADM1Code", "ActionGeo_ADM2Code", "ActionGeo_Lat", "ActionGeo_Long", "ActionGeo_FeatureID",
    "DATEADDED", "SOURCEURL",
]
FIELDS = {"export": len(EVENT_COLUMNS), "mentions": 10, "gkg": 20}
SUFFIXES = ("export", "mentions", "gkg")


def parse_file_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """(kind, url): the last token of each line, its kind by suffix; other lines go."""
    url = F.element_at(F.split(F.trim(value), r"\s+"), -1)
    kind = F.coalesce(*[F.when(F.lower(url).contains(f".{k}"), F.lit(k)) for k in SUFFIXES])
    return lines.filter(F.length(F.trim(value)) > 0).select(kind.alias("kind"), url.alias("url")).filter("kind is not null")


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str], least: int) -> DataFrame:
    """Text columns by position. Lines of fewer than ``least`` fields are skipped, fields over are left out."""
    return named_fields(spark.read.text(path), columns, least)


def named_fields(lines: DataFrame, columns: Sequence[str], least: int, value: str = "value") -> DataFrame:
    fields = lines.select(F.split(value, "\t", -1).alias("f")).filter(F.size("f") >= least)
    return fields.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def read_raw_events(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, EVENT_COLUMNS, len(EVENT_COLUMNS))


def read_raw_mentions(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, [f"m{i}" for i in range(FIELDS["mentions"])], FIELDS["mentions"])


def read_raw_gkg(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, [f"g{i}" for i in range(FIELDS["gkg"])], FIELDS["gkg"])


def read_zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, value): lines of every member of zip files. An archive is read as a stream, line by line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as archive:
                    for member in archive.namelist():
                        lines: list[str] = []
                        with archive.open(member) as f:
                            for line in io.TextIOWrapper(f, "utf-8", "replace", newline="\n"):
                                lines.append(line.rstrip("\r\n"))
                                if len(lines) == 10_000:
                                    yield piece(where, member, lines)
                                    lines = []
                        yield piece(where, member, lines)

    def piece(where: str, member: str, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([where] * n, pa.string()), pa.array([member] * n, pa.string()), pa.array(lines, pa.string())], names=["path", "member", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, member string, value string")


def with_field_count(lines: DataFrame, value: str = "value", separator: str = "\t") -> DataFrame:
    return lines.withColumn("fields", F.size(F.split(value, separator, -1)))


def validate_field_count(lines: DataFrame, kind: str, max_bad_ratio: float, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, bad) lines; raises if the share of bad ones is over the limit."""
    counted = with_field_count(lines, value)
    bad = F.col("fields") < FIELDS[kind]
    n = counted.agg(F.count("*").alias("all"), F.count_if(bad).alias("bad")).first()
    if n["all"] and n["bad"] / n["all"] > max_bad_ratio:
        raise ValueError(f"{n['bad']} of {n['all']} lines are short; {max_bad_ratio:.2%} are allowed")
    return counted.filter(~bad), counted.filter(bad)


def with_lineage(df: DataFrame, batch_id: str, line: str = "value", kind: str = "export") -> DataFrame:
    return df.withColumns({
        "source_file_url": F.col("_metadata.file_path"), "source_file_type": F.lit(kind), "ingest_batch_id": F.lit(batch_id),
        "ingest_time": F.current_timestamp(), "raw_line_hash": F.sha2(F.col(line), 256),
    })


def build_manifest(spark: SparkSession, lines: DataFrame, path: str, file: str = "source_file_url") -> DataFrame:
    """Rows and checksum of each file."""
    sums = spark.read.format("binaryFile").load(path).select(F.col("path").alias("p"), "length", F.sha2("content", 256).alias("sha256"))
    clean = lambda c: F.regexp_replace(c, "^file:/+", "/")
    rows = lines.groupBy(clean(F.col(file)).alias("file")).agg(F.count("*").alias("rows"))
    return rows.join(sums.withColumn("file", clean(F.col("p"))).drop("p"), "file", "right").fillna(0, ["rows"])


def new_only(df: DataFrame, loaded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that haven't been loaded; a second load of the same adds nothing."""
    return df.join(loaded.select(*keys), list(keys), "left_anti")


def backfill_slice(events: DataFrame, start: str, end: str, columns: Sequence[str], codes: Sequence[str], day: str = "event_date", ends: Sequence[str] = ("actor1_entity_id", "actor2_entity_id")) -> DataFrame:
    touches = F.lit(False)
    for c in ends:
        touches |= F.col(c).isin(*codes)
    return events.filter(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")) & touches).select(*columns)


def write_layer(df: DataFrame, path: str, by: str = "date") -> None:
    """Partitioned Parquet; only the dates at hand are replaced. A date's rows are dealt over several tasks."""
    df.repartition(by, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).option("compression", "zstd").parquet(path)


def write_snippets(df: DataFrame, path: str, by: str = "date") -> None:
    df.write.mode("append").partitionBy(by).json(path)


def register_views(spark: SparkSession, root: str, names: Sequence[str]) -> None:
    for name in names:
        spark.read.option("mergeSchema", True).parquet(f"{root}/{name}").createOrReplaceTempView(name)


def union_layers(layers: Sequence[DataFrame]) -> DataFrame:
    out = layers[0].select("*")  # a frame of spark.range() takes part as rows, not as numbers
    for layer in layers[1:]:
        out = out.unionByName(layer, allowMissingColumns=True)
    return out


def snapshot(df: DataFrame, name: str, day: str) -> DataFrame:
    """Date range, rows, and a checksum that doesn't depend on their order."""
    return df.agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.count("*").alias("row_count"), F.bit_xor(F.xxhash64(*df.columns)).alias("checksum")).withColumn("name", F.lit(name))


def retained(df: DataFrame, as_of: str, days: int, day: str = "date") -> DataFrame:
    return df.filter(F.col(day) >= F.date_sub(F.lit(as_of).cast("date"), days))


def rebuild_dates(df: DataFrame, changed: DataFrame, key: str, day: str) -> DataFrame:
    """Dates that hold a key whose mapping has changed."""
    return df.join(changed.select(key), key, "left_semi").select(day).distinct()


def lookup(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Configuration as a table to be broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))
