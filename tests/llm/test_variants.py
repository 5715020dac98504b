import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from presslens.llm import variants


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(counts):
    """The same table, from every pair."""
    beside = defaultdict(list)
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if near(a, b):
                beside[a].append(b)
                beside[b].append(a)
    form = {}
    for w in words:
        best = min(beside[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 5 * counts[w]:
            form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, counts[w], len(beside[w]), form.get(w), counts[form[w]] if w in form else None, root))
    return out


def rows(df):
    return {tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()}


def test_groups_equal_brute_force(spark):
    rng = random.Random(4)
    counts = {}
    for _ in range(40):
        seed = "".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 14)))
        for _ in range(30):
            w = list(seed)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "þ"])
            if len(w) >= 6:
                counts["".join(w)] = rng.choice([5, 6, 25, 30, 130, 700, 4000])
    counts |= {"a" * n: 5 ** (n % 4 + 1) for n in range(6, 30)}  # one letter only
    counts |= {"ab" * 3 + "x" * n: 5 * 6**n for n in range(5)}  # a chain of forms
    counts |= {"x" * 100_000: 7, "x" * 99_999: 70}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(variants.variant_groups(df)) == plain(counts)
    pairs = variants.near_pairs(df).select("word", "other").collect()
    assert len(pairs) == len({frozenset(p) for p in pairs})  # each once


def test_equal_frequencies_take_the_smallest_word_and_chains_end_at_the_last(spark):
    counts = {"spelling": 5, "spellinga": 40, "spellingb": 40, "spellingbb": 250, "spellingbbb": 1300, "lonely": 9}
    got = {r[0]: r for r in rows(variants.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long")))}
    assert got["spelling"][3] == "spellinga" and got["spellingb"][5] == "spellingbbb" and got["spellingb"][3] == "spellingbb"
    assert got["lonely"] == ("lonely", 9, 0, None, None, "lonely")


def words_of(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize("rows_", ["many", "none"])
def test_words_of_documents(spark, rows_):
    rng = random.Random(5)
    vocabulary = ["Reading", "ÉTUDIER", "étudier", "wordsworth", "short", "straße", "naïveté", "a×b÷cdefg"] + ["".join(rng.choice("aeinth") for _ in range(7)) for _ in range(30)]
    docs = [(rng.randint(0, 400), " ".join(rng.choices(vocabulary, k=60)) + rng.choice([".", "\n", "1"])) for _ in range(300)]
    docs += [(None, "reading reading"), (3, None), (4, ""), (5, "the same row " * 3), (5, "the same row " * 3), (6, "repetition" * 50_000)]
    docs = docs if rows_ == "many" else []
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, word string, n int")
    counts = words_of(docs)
    assert rows(variants.variant_groups(variants.counted(variants.with_slips(variants.runs_of(df))))) == plain(counts)
    assert len(counts) > 20 or rows_ == "none"


def test_no_table_of_words_goes_through_the_driver(spark):
    words = spark.createDataFrame([("banana", 50), ("bananas", 6), ("cherry", 9)], "word string, n long")
    pairs = variants.near_pairs(words)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString() and pairs.count() == 1
    out = variants.variant_groups(words)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out) == plain({"banana": 50, "bananas": 6, "cherry": 9})
