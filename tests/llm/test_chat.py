import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from presslens.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<|user|>\nhi</s>\n", "\\", "\\\\<\\|", "<<|>|>", "<", "a<", "|", "\\</s>", "", None, "é🙂<|漢|>", "<<SYS>>x<</SYS>>", "<</s>", "line\nbreak\n"]


def expected(rows):
    text = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def read(spark, rows, schema="conv_id long, turn long, role string, text string"):
    turns = spark.createDataFrame(rows, schema).withColumn("part", F.lit("clash")).repartition(3)
    formatted = chat.format_chats(turns)
    return formatted, {r["conv_id"]: r for r in chat.read_back(formatted).collect()}


def test_round_trip_of_control_strings(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)] + [(2, i, t, t) for i, t in enumerate(NASTY)] + [(-7, 0, "user", NASTY[0]), (-7, 1, "assistant", NASTY[0])]
    formatted, got = read(spark, rows)
    for conv in (1, 2, -7):
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected([(x[2], x[3]) for x in rows if x[0] == conv])
    assert got[-7]["formatted_chars"] == sum(len(r["formatted"]) for r in formatted.collect() if r["conv_id"] == -7)
    inside = [r["formatted"][s["start"] : s["end"]] for r in formatted.collect() for s in r["loss"]]
    assert inside and not any(c in x for c in chat.CONTROLS for x in inside)


def test_long_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 7)
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(95)] + [(2, 3, "user", "same")] * 30 + [(3, None, None, None), (3, 0, "assistant", "x"), (None, 0, "assistant", "y")]
    formatted, got = read(spark, rows)
    assert got[1]["turns_sha256"] == expected([(r[2], r[3]) for r in rows[:95]])[1]
    assert got[2]["n_turns"] == 30 and got[3]["n_turns"] == 2 and got[None]["loss_chars"] == 1
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_turns_without_a_number_are_dealt_over_many_tasks(spark):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    rows = [(5, None if i % 2 else 1, "assistant" if i % 3 else "user", f"{i:05d} of equal turns") for i in range(4000)]
    formatted, got = read(spark, rows)
    parts = {r["part"]: r["n"] for r in formatted.groupBy("part").agg(F.count("*").alias("n")).collect()}
    ordered = sorted(((r[1] is not None, r[1] or 0, r[2], r[3]) for r in rows))
    assert got[5]["turns_sha256"] == expected([(r[2], r[3]) for r in ordered])[1] and len(parts) >= 3
    spark.conf.set(setting, "true")


def test_a_very_long_text_is_whole(spark):
    long = "é<|x|>\\ and so on " * 200_000
    _, got = read(spark, [(1, 0, "user", "short"), (1, 1, "assistant", long), (1, 2, "user", "last")])
    assert tuple(got[1])[1:5] == expected([("user", "short"), ("assistant", long), ("user", "last")])


def test_pieces_bound_a_part(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 4)
    formatted, got = read(spark, [(1, 0, "user", str(i)) for i in range(11)])
    assert sorted(r["piece"] for r in formatted.collect()) == [0, 1, 2] and got[1]["n_turns"] == 11


def test_escaping_is_reversible():
    column = pa.array([t or "" for t in NASTY])
    assert [chat.unescape(x) for x in chat.escaped(column).to_pylist()] == column.to_pylist()
