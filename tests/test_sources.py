import zipfile

import pytest
from pyspark.sql import functions as F

from presslens.sources import raw
from presslens.sources.layers import diff_snapshots

LINES = ["\t".join(f"{i}_{c}" for c in range(n)) for i, n in enumerate([61, 61, 60, 62])] + ["", ""]


def test_columns_add_up():
    assert len(raw.EVENT_COLUMNS) == 61 == len(set(raw.EVENT_COLUMNS))


def test_short_rows_are_skipped_and_counted(spark, tmp_path):
    (tmp_path / "a.export.CSV").write_text("\n".join(LINES))
    rows = raw.read_raw_events(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and rows[0]["GlobalEventID"] == "0_0" and rows[0]["SOURCEURL"] == "0_60"
    lines = spark.read.text(str(tmp_path))
    good, bad = raw.validate_field_count(lines, "export", 0.5)
    assert (good.count(), bad.count()) == (3, 2)
    with pytest.raises(ValueError, match="short"):
        raw.validate_field_count(lines, "export", 0.1)


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("x.csv", "first line\nsecond line\n")
    assert [r["value"] for r in raw.read_zipped_lines(spark, str(tmp_path)).collect()] == ["first line", "second line"]


def test_file_list(spark):
    lines = spark.createDataFrame([("10 abc http://h/2.export.CSV.zip",), ("11 d http://h/2.gkg.csv.zip",), ("",), ("nothing here",)], "value string")
    assert [tuple(r) for r in raw.parse_file_list(lines).collect()] == [("export", "http://h/2.export.CSV.zip"), ("gkg", "http://h/2.gkg.csv.zip")]


def test_layers_are_replaced_by_date_and_manifest_counts(spark, tmp_path):
    day = lambda d, n: spark.range(n).select(F.lit(d).cast("date").alias("date"), F.col("id"))
    path = str(tmp_path / "layer")
    raw.write_layer(day("2024-01-01", 5).unionByName(day("2024-01-02", 3)), path)
    raw.write_layer(day("2024-01-02", 4), path)
    assert {str(r["date"]): r["count"] for r in spark.read.parquet(path).groupBy("date").count().collect()} == {"2024-01-01": 5, "2024-01-02": 4}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("x\ny\n")
    lined = raw.with_lineage(spark.read.text(str(tmp_path / "t")), "b1")
    (m,) = raw.build_manifest(spark, lined, str(tmp_path / "t")).collect()
    assert m["rows"] == 2 and len(m["sha256"]) == 64 and m["length"] == 4
    raw.write_snippets(day("2024-01-01", 2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    raw.register_views(spark, str(tmp_path), ["layer"])
    assert spark.table("layer").count() == 9
    assert raw.lookup(spark, [("a", 1)], "k string, v int").count() == 1


def test_new_only_snapshot_and_diff(spark):
    a, b = spark.range(5), spark.range(3, 9)
    assert raw.new_only(b, a, ["id"]).count() == 4 and raw.new_only(a, a, ["id"]).count() == 0
    x, y = (raw.snapshot(d.withColumn("date", F.lit("2024-01-01").cast("date")), "s", "date").first() for d in (a, a.orderBy(F.desc("id"))))
    assert x == y and x["row_count"] == 5
    assert {r["change"]: r["n"] for r in diff_snapshots(a, b).collect()} == {"added": 4, "removed": 3, "kept": 2}
    assert raw.union_layers([a, b.withColumn("more", F.lit(1))]).columns == ["id", "more"]


def test_scratch_needs_no_setting_and_is_cleared(spark):
    from pathlib import Path

    from presslens import scratch

    with scratch.workspace(spark) as work:
        kept = work.keep(spark.range(3), "numbers")
        assert kept.count() == 3
        inside = Path(work.path.removeprefix("file:"))
        assert inside.exists()
    assert not inside.exists()
    assert scratch.materialize(spark.range(0), "none").count() == 0
