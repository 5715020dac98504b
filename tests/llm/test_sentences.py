import hashlib
import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2, sentencepiece_pb2

from presslens.llm import bpe, sentences


def model_with(rule=None, **options):
    """The public model, or the same pieces with another normaliser."""
    with open(sentences.default_path(), "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    if rule:
        spec = sentencepiece_model_pb2.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()).normalizer_spec
        model.normalizer_spec.CopyFrom(spec)
    for k, v in options.items():
        setattr(model.normalizer_spec, k, v)
    return model.SerializeToString()


MODELS = {
    "own": {},
    "nfkc": {"rule": "nmt_nfkc", "remove_extra_whitespaces": True},
    "folded": {"rule": "nfkc_cf", "remove_extra_whitespaces": False, "add_dummy_prefix": False},
    "collapsed": {"remove_extra_whitespaces": True, "add_dummy_prefix": True},
}
FIXED = ["", " ", "  ", "   a", "a  ", "\n\n", "<s></s><unk><0x41>", "▁", "▁▁ a", "a\u0000b", "　 x", "ﬁ１", "a" * 5000, " " * 3000, "thein" * 2000, "x▁ ▁y ", "éà́", "㌀ ﷺ  ﷺ", "Ⅷ½ … ¨ ´a ¨", "﻿a​b", "\U0001d4b3x \U0001f642"]


@pytest.fixture(scope="module", params=list(MODELS))
def pair(request):
    model = model_with(**MODELS[request.param])
    return sentences.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def texts(n, seed):
    rng = random.Random(seed)
    letters = "abcdeghinorst    \n\tABÉéàñçÀßﬁ１0123'.,▁ あ漢🙂́ 　İΣ½㌀¨"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["".join(rng.choice("aeinthr ") for _ in range(rng.randint(1, 90))) for _ in range(n)]


def unpacked(flat, counts):
    ends = counts.cumsum()
    return [flat[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]


def test_ids_spans_and_text_equal_the_library(pair):
    ours, library = pair
    many = texts(2500, 8) + FIXED
    flat, counts, begins, ends = ours.encode(many)
    assert unpacked(flat, counts) == library.encode(many, num_threads=1)
    for text, b, e in zip(many, unpacked(begins, counts), unpacked(ends, counts), strict=True):
        found = sentencepiece_pb2.SentencePieceText.FromString(library.encode(text, out_type="serialized_proto")).pieces
        assert (b, e) == ([p.begin for p in found], [p.end for p in found]), text
    assert ours.decode(bpe.listed(flat, counts)).to_pylist() == [library.decode(i) for i in unpacked(flat, counts)]


def test_every_code_point(pair):
    ours, library = pair
    points = [f"a{chr(c)}b {chr(c)}" for c in range(0, 0x110000, 11) if not 0xD800 <= c < 0xE000]
    flat, counts, _, _ = ours.encode(points)
    assert unpacked(flat, counts) == library.encode(points, num_threads=1)


def test_decoding_of_any_ids(pair):
    ours, library = pair
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([*range(0, 300), rng.randrange(32000), 259, 28705]) for _ in range(rng.randint(0, 7))]
        flat, counts = sentences.np.array(ids, sentences.np.int32), sentences.np.array([len(ids)])
        assert ours.decode(bpe.listed(flat, counts)).to_pylist() == [library.decode(ids)], ids


def test_words_are_forgotten_and_learned_again(monkeypatch):
    ours, library = sentences.Pieces(model_with()), sentencepiece.SentencePieceProcessor(model_proto=model_with())
    monkeypatch.setattr(sentences, "CACHE_WORDS", 1)
    for text in ("alpha beta", "gamma alpha", "b" * 100 + " alpha"):
        assert ours.encode([text])[0].tolist() == library.encode(text)
    assert "b" * 100 not in ours.words and "▁alpha" in ours.words


def test_frames(spark):
    rows = [(1, "Hello  world", "a"), (2, None, "b"), (2, "", "b"), (2, "", "b"), (None, "é\n" * 30000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = sentences.piece_encode(docs, decoded=True)
    assert coded.count() == 5
    back = sentences.piece_decode(coded.withColumnRenamed("decoded", "first"), keys=("doc_id", "first")).collect()
    assert all(r["first"] == r["decoded"] for r in back) and sorted(r["decoded"] for r in back) == sorted(t or "" for _, t, _ in rows)
    assert sentences.piece_encode(docs.limit(0)).count() == 0
    nulls = coded.selectExpr("doc_id", "cast(null as array<int>) as ids")
    assert {r["decoded"] for r in sentences.piece_decode(nulls).collect()} == {""}
    cut = [(rows[0][1].encode()[b:e].decode()) for r in coded.filter("doc_id = 1").collect() for b, e in zip(r["begins"], r["ends"], strict=True)]
    assert "".join(cut) == "Hello  world"


def test_models_of_another_kind_are_refused():
    model = sentencepiece_model_pb2.ModelProto.FromString(model_with())
    model.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError):
        sentences.Pieces(model.SerializeToString())
    model.trainer_spec.byte_fallback, model.normalizer_spec.escape_whitespaces = True, False
    with pytest.raises(ValueError):
        sentences.Pieces(model.SerializeToString())


def test_query_on_texts_without_pieces(spark, tmp_path):
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    library = sentencepiece.SentencePieceProcessor(model_proto=model_with())
    got = {r["doc_id"]: r for r in sentences.op12_sentencepiece(spark, str(tmp_path)).collect()}
    for doc_id, text in rows:
        ids = library.encode(text or "")
        r = got[doc_id]
        assert (r["n_tokens"], r["n_bytes"]) == (len(ids), len((text or "").encode()))
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
