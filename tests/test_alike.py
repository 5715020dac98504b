import random

import numpy as np
import pytest

from presslens.operators import alike, evidence
from tests.test_round3 import counted

SCHEMA = "article_id long, text string"


def brute_sets(text):
    words = text.lower().split()
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute_groups(rows, threshold=0.8):
    """The smallest id of each row's group, by all pairs."""
    sets = {i: None if t is None else brute_sets(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            x, y = sets[i], sets[j]
            if j < i and (x == y if not x or not y else len(x & y) >= threshold * len(x | y) - 1e-9):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def changed(rng, text, times):
    words = text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


def texts(seed):
    """Near copies of one text and of others, chains of them, a passage that many hold, long texts, short ones and none."""
    rng, out = random.Random(seed), []
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(260):
        if out and i % 5:
            out.append(changed(rng, out[0 if i % 3 else rng.randrange(len(out))], rng.randrange(1, 9)))
        else:
            out.append(" ".join([f"w{rng.randrange(3000)}" for _ in range(200 if not i else rng.choice([3, 6, 9, 40, 200]))] + [passage] * (i % 2)))
    long = " ".join(f"l{rng.randrange(9000)}" for _ in range(1500))
    out += [long, changed(rng, long, 20), changed(rng, long, 400), " ".join(long.split(" ")[:1300])]
    return [*out, "", None, " \t", None, "a b c", "A  b\nc", "a b c d e f g h", "a b c d e f g h i", "Été À ß", "été à ß"]


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.8), (2, 0.8), (3, 0.6), (4, 0.95)])
def test_groups_are_those_of_all_pairs(spark, seed, threshold):
    rows = list(enumerate(texts(seed)))
    got = evidence.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(5), threshold)
    assert got.columns == ["article_id", "group_id"]
    assert {r["article_id"]: r["group_id"] for r in got.collect()} == brute_groups(rows, threshold)


def test_pairs_at_the_threshold_are_all_found(spark):
    rng, rows = random.Random(7), []
    for i in range(0, 1200, 2):  # 90 shingles, 10 of them changed in each: a similarity of 80 in 100
        words = [f"w{i}_{k}" for k in range(94)]
        other = [*words[:44], f"x{i}", *words[45:88], f"y{i}", *words[89:]]
        rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
    rng.shuffle(rows)
    got = {r["article_id"]: r["group_id"] for r in evidence.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i in got if i % 2 and got[i] != i - 1} == set()


def test_f6_articles_are_read_once(spark):
    rows, made = counted(spark, spark.createDataFrame([(i, f"some words of text {i % 7} and some more") for i in range(50)], SCHEMA))
    assert len(evidence.near_copies(rows).collect()) == made.value == 50


def test_long_lists_are_compared_by_blocks(spark):
    rng = random.Random(3)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(90)], np.int64)) for _ in range(60)]
    rows = [(5, i // 16, len(s), i, 0, i, i, alike.parities(s, alike.WIDTH)) for i, s in enumerate(sorted(sets, key=len))]
    named = spark.createDataFrame(rows, "h long, block int, n int, node long, place int, before long, root long, bits binary")
    got = [tuple(r) for r in alike.block_pairs(named, 0.65).collect()]
    sets.sort(key=len)
    alone = {(i, j) for i in range(60) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.65 * len(np.union1d(sets[i], sets[j]))}
    assert len(got) == len(set(got)) and {(j, i) for i, j in alone} <= set(got) and alone
    same = spark.createDataFrame([(*r[:6], 1, r[7]) for r in rows], named.schema)
    assert alike.block_pairs(same, 0.65).count() == 0


def test_shingles_do_not_depend_on_what_stands_beside_them():
    given = [(t or "").lower().encode() for t in texts(5)]
    together = list(alike.shingles(given))
    assert all((s == next(iter(alike.shingles([t])))).all() for s, t in zip(together, given, strict=True))
    assert [len(s) for s in together] == [len(brute_sets(t.decode())) for t in given]
