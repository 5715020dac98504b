import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from presslens.llm import quality_rules

TEXTS = [
    None, "", " \n\t ", "one", "a b c d e a b c d e", "x y\nx y\n\n\nx y\r", "### ||| $$ ok", "word " * 50, "a b c d e f a b c d e f g a b c d e",
    "The quick brown fox jumps over the lazy dog, and then it sleeps for a while.\nLater it wakes up again and runs away into the dark forest.",
    "STOP!! BUY!! NOW!! THIS!! IS!! THE!! BEST!! OFFER!! EVER!! MADE!! CALL!! US!!", "naïve café é\x0bü\x0c\x1cz", " 1 2 3 4 5 1 2 3 4 5 6 ",
]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = Counter(windows)
    covered = {j for i, w in enumerate(windows) if twice[w] > 1 for j in range(i, i + 5)}
    lines, seen, dup = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_counts_match_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("votes", F.lit(1)).withColumn("q_words", F.lit(2))
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t), t
        assert r["base_failed"] == (brute(t)[0] < 10 or 100 * brute(t)[4] > 20 * brute(t)[0])
        assert not (r["base_failed"] and r["kept"])
    assert got[9]["kept"] and not got[10]["kept"]


def test_em_matches_plain_python_and_finds_the_bad_rule(spark):
    # rules 0 and 1 agree on truth, rule 2 is right three times in five
    rows = [([1, 1, 1], 50), ([-1, -1, -1], 20), ([1, 1, -1], 33), ([-1, -1, 1], 14), ([0, 1, -1], 5), ([0, 0, 0], 3), ([1, -1, 0], 1)]
    patterns = spark.createDataFrame(rows, "votes array<int>, n long")
    trust = quality_rules.fit(patterns, 3, rounds=8, tolerance=0.0)
    acc = [0.8] * 3
    for _ in range(8):
        right, voted = [5 * 0.8] * 3, [5.0] * 3
        for votes, n in rows:
            odds = 1.0
            for v, a in zip(votes, acc, strict=True):
                odds *= (a / (1 - a)) ** v
            p = odds / (1 + odds)
            for i, v in enumerate(votes):
                voted[i] += n * abs(v)
                right[i] += n * (p if v > 0 else 1 - p if v < 0 else 0)
        acc = [min(max(r / v, 0.55), 0.99) for r, v in zip(right, voted, strict=True)]
    assert trust.accuracy == pytest.approx(acc, abs=1e-9)
    assert trust.accuracy[2] < 0.75 < trust.accuracy[0]


def test_em_runs_until_it_settles(spark):
    rows = [([-1, 1, -1], 135), ([-1, 0, 0], 246), ([1, 0, -1], 53), ([0, -1, 0], 226), ([1, -1, 1], 233), ([0, 1, -1], 307)]
    patterns = spark.createDataFrame(rows, "votes array<int>, n long").coalesce(1)
    settled = quality_rules.fit(patterns, 3, tolerance=1e-5)
    assert settled.accuracy == pytest.approx((0.9783, 0.55, 0.8676), abs=1e-3)  # where plain Python ends after 113 rounds
    assert quality_rules.fit(patterns, 3, rounds=12, tolerance=1e-3).accuracy[0] < 0.96


def test_kept_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, t, "src", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, q_kept long")
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert 9 in {r["doc_id"] for r in kept.collect()} and 10 not in {r["doc_id"] for r in kept.collect()}
    assert quality_rules.kept_documents(docs.limit(0)).count() == 0
