import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from presslens.llm import bpe


@pytest.fixture(scope="module")
def pair():
    with open(bpe.default_path(), encoding="utf-8") as f:
        return bpe.Vocabulary(f.read()), Tokenizer.from_file(bpe.default_path())


def expected(tokenizer, texts):
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def got(v, texts):
    flat, counts = v.encode(texts)
    ends = np.cumsum(counts)
    return [flat[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]


def test_random_texts(pair):
    v, t = pair
    rng = random.Random(3)
    letters = "abcdefghilmnorstuvxyzABCΣσςİıßéàñçÀ0123'9 <|>#.\t\n\x1c\x85 ​あ漢🙂éaaaathein"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice("aeinthr") for _ in range(rng.randint(1, 30))) for _ in range(5000)]
    texts += ["<|endoftext|>a<|startoftext|>", "x<|endoftext|>", "a" * 5000, "#" * 3001, "thein" * 2000, "", " ", "It's we'll I'M DON'T", "O'Σ ΑΣ ΑΣ. "]
    assert got(v, texts) == expected(t, texts)
    flat, counts = v.encode(texts)
    assert v.decode(bpe.listed(flat, counts)).to_pylist() == [t.decode(i, skip_special_tokens=False) for i in expected(t, texts)]


def test_every_code_point(pair):
    v, t = pair
    points = [f"a{chr(c)}b" for c in range(0, 0x110000, 3) if not 0xD800 <= c < 0xE000]
    assert got(v, points) == expected(t, points)


def test_speculation_is_used_and_forgotten_words_are_learned_again(pair, monkeypatch):
    v, t = pair
    v.words.clear()
    before = v.merged_words
    v.encode(["the cat sat on the mat with another house and water"])
    assert v.merged_words == before  # all proposals stood
    monkeypatch.setattr(bpe, "CACHE_WORDS", 1)
    assert got(v, ["alpha beta"]) + got(v, ["gamma alpha"]) == expected(t, ["alpha beta", "gamma alpha"])


def test_round_trip_on_frames(spark, pair):
    rows = [(1, "Hello world", "a"), (2, None, "b"), (2, "", "b"), (None, "x<|endoftext|>" * 40, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.bpe_encode(docs, decoded=True)
    back = bpe.bpe_decode(coded.withColumnRenamed("decoded", "first"), keys=("doc_id", "first"))
    assert all(r["first"] == r["decoded"] for r in back.collect())
    sums = bpe.digests(coded, ["doc_id"]).orderBy("doc_id", "n_tokens").collect()
    assert [r["n_tokens"] for r in sums] == [80, 2, 0, 0]
    assert bpe.bpe_encode(docs.limit(0)).count() == 0
    nulls = coded.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert {r["decoded"] for r in bpe.bpe_decode(nulls).collect()} == {""}
