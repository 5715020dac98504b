import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from presslens.llm import simhash


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def texts(n, seed=1):
    rng, out = random.Random(seed), []
    vocabulary = [f"w{i}é" for i in range(300)]
    for i in range(n):
        if out and i % 3 == 0:
            words = rng.choice(out).split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 40, 400]))]
        out.append(" ".join(words))
    return [*out, "", " \n", out[1], out[1].upper(), "\x1c a b", "tab\tand\x0bmore here"]


def test_components_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate([*texts(120), None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).repartition(5)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    assert [got[i]["fingerprint"] for i in range(len(rows))] == [f"{x:016x}" for x in fps]
    assert [got[i]["component_id"] for i in range(len(rows))] == brute_components(fps)


def clusters(seed=1):
    rng, near = np.random.default_rng(seed), set()
    for b in rng.integers(0, 2**63, 4, dtype=np.uint64):
        for _ in range(120):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(k)
            near.add(x)
    return np.array(sorted(near), np.uint64)


def test_pairs_by_table():
    f = clusters()
    want = {(a, b) for a in range(len(f)) for b in range(a + 1, len(f)) if bin(int(f[a] ^ f[b])).count("1") <= 2}
    assert set(zip(*(x.tolist() for x in simhash.tabled_pairs(f)), strict=True)) == want and len(want) > 1000


def test_pivot_tables_discard_all_but_few(monkeypatch):
    f = clusters()
    all_pairs = len(f) * (len(f) - 1) // 2
    tables = np.bitwise_count(f[:, None] ^ simhash.pivots()[None, :]).astype(int)
    left = sum(int((np.abs(tables[i] - tables[i + 1 :]).max(axis=1) <= 2).sum()) for i in range(len(f)))
    assert len(simhash.tabled_pairs(f)[0]) <= left < 0.1 * all_pairs


def test_links_connect_what_all_pairs_connect(spark):
    f = clusters(3)
    nodes = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long").repartition(5)
    root = {int(np.int64(np.uint64(x))) if x < 2**63 else int(x) - 2**64: int(x) for x in f.tolist()}
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes)).collect()}
    signed = list(root)
    want = brute_components([x & (2**64 - 1) for x in signed])
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(want[i], set()).add(x)
    found = {}
    for x in signed:
        found.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_long_chain_is_one_component(spark):
    chain = [(1 << (k // 2 + 1)) - 1 if k % 2 else ((1 << (k // 2)) - 1) for k in range(60)]
    edges = spark.createDataFrame([(a, b) for a, b in zip(chain, chain[1:], strict=False)] + [(1000, 1001)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert set(roots.values()) == {0, 1000} and len(roots) == len(set(chain))


def test_one_of_each(spark):
    rows = [(5, "a b c d", "x"), (3, "a b c d", "y"), (7, "other words are here now", "z"), (7, "other words are here now", "z"), (None, "a b c d", "n"), (9, None, "q"), (8, "", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stays string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 7, 8]
    assert simhash.one_of_each(docs.limit(0)).count() == 0
