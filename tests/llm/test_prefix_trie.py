import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from presslens.llm import prefix_trie
from presslens.scratch import workspace

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The same nodes from plain tuples."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in turns.items()}
    members = defaultdict(list)
    full = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - c % 100, [])[:h] + said[h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    children, subtree = defaultdict(int), defaultdict(lambda: [0, 0])
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        own_saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            subtree[p[:d]][0] += p not in children
            subtree[p[:d]][1] += own_saved
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children.get(p, 0), *subtree[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if full[c] == p))).encode()).hexdigest())
        for p, m in members.items()
    )


def ours(spark, rows, folder):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    df.write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    got = prefix_trie.op11_prefix_trie(spark, str(folder)).select(*COLUMNS).collect()
    return sorted(tuple(-1 if x is None else x for x in r) for r in got)


def made(seed, n, longest, words=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.05:
            continue  # absent, now and then the first of its hundred
        for t in range(rng.choice([1, 2, 3, 5, 8, longest])):
            rows.append((c, t, rng.choice(["user", "user", "assistant", None]), rng.choice(["ja", "né" * 3, "", None][:words])))
    return rows


@pytest.mark.parametrize("batch", [7, 10_000])
def test_nodes_equal_brute_force(spark, tmp_path, batch):
    rows = made(1, 420, 9) + [(5000, 3, "user", "tie"), (5000, 3, "user", "tie"), (5000, None, "user", "first"), (5000, 3, "a", "tie"), (None, 0, "user", "no one"), (5001, 0, None, None)]
    rows += [(c, 0, "user", "the same") for c in range(6000, 6300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert ours(spark, rows, tmp_path) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_conversations_of_many_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows = []
    for c in range(60):
        length = rng.choice([1, 63, 64, 65, 128, 129, 200, 700])
        split = rng.choice([0, 10, 64, 130, 300])
        rows += [(c, t, "user", "same" if t < split else f"own {c % 7} {t % 5}") for t in range(length)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        assert ours(spark, rows, tmp_path) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_conversation_over_many_ranges_is_numbered_in_order(spark):
    df = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "'user' as role", "cast(id as string) as text")
    with workspace(spark) as work:
        got = prefix_trie.numbered(df, work).orderBy("at").collect()
        assert [r["at"] for r in got] == list(range(20_000)) and [r["chars"] for r in got[:11]] == [1] * 10 + [2]


def test_no_conversations(spark, tmp_path):
    assert ours(spark, [], tmp_path) == []
    assert ours(spark, [(None, 1, "user", "x")], tmp_path) == []
