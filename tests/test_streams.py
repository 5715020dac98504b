from pyspark.sql import functions as F

from presslens.streaming import streams

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_each_file_once(spark, tmp_path):
    schema = spark.read.parquet(EVENTS).schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(EVENTS).filter("event_id % 2 = 0").write.parquet(str(tmp_path / "in" / "a"))
    read = lambda: streams.stream_files(spark, str(tmp_path / "in" / "*"), schema)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        streams.run_to_files(read(), out, check)
    n = spark.read.parquet(out).count()
    spark.read.parquet(EVENTS).filter("event_id % 2 = 1").write.parquet(str(tmp_path / "in" / "b"))
    streams.run_to_files(read(), out, check)
    assert (n, spark.read.parquet(out).count()) == (spark.read.parquet(EVENTS).filter("event_id % 2 = 0").count(), spark.read.parquet(EVENTS).count())


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    rows = lambda *ts: spark.createDataFrame([(t, "a", 1.0) for t in ts], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    path, check, out = str(tmp_path / "in"), str(tmp_path / "check"), str(tmp_path / "out")
    rows("2024-01-01 00:00:00", "2024-01-03 00:00:00").coalesce(1).write.parquet(path)
    run = lambda: streams.run_to_files(streams.stream_counts(streams.stream_files(spark, path, rows().schema), "1 hour", late="1 hour"), out, check)
    run()
    rows("2024-01-01 00:30:00", "2024-01-05 00:00:00").coalesce(1).write.mode("append").parquet(path)
    run()
    rows("2024-01-07 00:00:00").coalesce(1).write.mode("append").parquet(path)
    run()
    got = {str(r["start"]): r["n"] for r in spark.read.parquet(out).collect()}
    assert got["2024-01-01 00:00:00"] == 1  # the late row didn't count


def test_only_touched_dates_are_rebuilt(spark, tmp_path):
    schema = "date date, k string, v long"
    day = lambda d, v: spark.createDataFrame([(d, "x", v)], "date string, k string, v long").withColumn("date", F.col("date").cast("date"))
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    day("2024-01-01", 1).unionByName(day("2024-01-02", 5)).write.parquet(src)
    run = lambda: streams.upsert_dates(streams.stream_files(spark, src, day("2024-01-01", 1).schema), out, check, ["k"], [F.sum("v").alias("v")])
    run()
    day("2024-01-02", 7).write.mode("append").parquet(src)
    run()
    got = {str(r["date"]): r["v"] for r in spark.read.parquet(f"{out}/gold").collect()}
    assert got == {"2024-01-01": 1, "2024-01-02": 12} and schema
    commit = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commit.unlink()  # as if it had stopped before it was done
    commit.with_name(f".{commit.name}.crc").unlink(missing_ok=True)
    run()
    assert {str(r["date"]): r["v"] for r in spark.read.parquet(f"{out}/gold").collect()} == got


def test_decay_matches_the_batch_form(spark, tmp_path):
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.createDataFrame([("a", f"2024-01-0{i} 00:00:00", float(i)) for i in (1, 2, 5)], "k string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    df = streams.stream_decay(streams.stream_files(spark, str(tmp_path / "in"), rows.schema), "k", 1.0)
    (r,) = streams.run_to_table(df, str(tmp_path / "out"), str(tmp_path / "check"), "update").collect()
    spark.conf.set(setting, before)
    assert abs(r["level"] - (5 + 2 / 8 + 1 / 16)) < 1e-9


def test_late_rows_correct_their_days(spark, tmp_path):
    schema = "ts timestamp, k string, v long, date date"
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")

    def send(*rows):
        df = spark.createDataFrame(list(rows), "ts string, k string, v long").withColumn("ts", F.col("ts").cast("timestamp"))
        df.withColumn("date", F.to_date("ts")).coalesce(1).write.mode("append").parquet(src)
        run()

    def run():
        streams.stream_corrected(streams.stream_files(spark, src, spark.createDataFrame([], schema).schema), out, check, ["k"], {"n": F.count("*"), "v": F.sum("v")}, "1 day")

    found = lambda part: {(str(r["date"]), r["k"], r["n"], r["v"], r["sign"]) if part == "corrections" else (str(r["date"]), r["k"], r["n"], r["v"]) for r in streams.corrected(spark, out, part).collect()}
    send(("2024-01-01 00:00:00", "a", 1), ("2024-01-01 01:00:00", None, 2), ("2024-01-05 12:00:00", "a", 3))
    send(("2024-01-04 12:00:00", "a", 5), ("2024-01-06 00:00:00", "a", 7))  # within a day: in time
    assert found("gold") == {("2024-01-01", "a", 1, 1), ("2024-01-01", None, 1, 2), ("2024-01-05", "a", 1, 3), ("2024-01-04", "a", 1, 5), ("2024-01-06", "a", 1, 7)}
    send(("2024-01-01 02:00:00", None, 10), ("2024-01-02 00:00:00", "b", 20), ("2024-01-06 01:00:00", "a", 30), (None, "c", 40))
    want = {("2024-01-01", "a", 1, 1), ("2024-01-01", None, 2, 12), ("2024-01-02", "b", 1, 20), ("2024-01-05", "a", 1, 3), ("2024-01-04", "a", 1, 5), ("2024-01-06", "a", 2, 37), ("None", "c", 1, 40)}
    signed = {("2024-01-01", None, 1, 2, -1), ("2024-01-01", None, 2, 12, 1), ("2024-01-02", "b", 1, 20, 1)}
    assert found("gold") == want and found("corrections") == signed
    commit = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commit.unlink()  # as if it had stopped before it was done
    commit.with_name(f".{commit.name}.crc").unlink(missing_ok=True)
    run()
    assert found("gold") == want and found("corrections") == signed
    assert spark.read.parquet(f"{out}/late").count() == 2
