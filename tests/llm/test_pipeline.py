
from pyspark.sql import functions as F

import corpus_pipeline
from presslens.llm import line_dedup, quality_rules
from presslens.llm.common import materialize, table
from tests.llm.test_mixing import copies
from tests.llm.test_near_copies import brute_firsts

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents").cache()
    before = {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "bpe"]
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality_rules"](spark, docs, SF)
    assert good.columns == docs.columns
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality_rules.judge(docs).filter("kept").collect()}

    cut = stages["line_dedup"](spark, good, SF)
    assert cut.columns == docs.columns and cut.count() == good.count()
    texts = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(good).collect()}
    for r in cut.collect():
        assert r["text"] == texts[r["doc_id"]] and r["n_chars"] == (len(r["text"]) if r["text"] != before[r["doc_id"]]["text"] else before[r["doc_id"]]["n_chars"])

    one = stages["simhash_near_dedup"](spark, cut, SF)
    ids = sorted(texts)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == brute_firsts([(i, texts[i]) for i in ids])

    mixed = stages["mixing"](spark, one, SF)
    rows = one.collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].encode()) + 1
    want = {r["doc_id"]: copies(r["doc_id"], r["text"], sum(sizes.values()) / len(sizes) / sizes[r["source"]]) for r in rows}
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert mixed.columns == docs.columns and got == {k: v for k, v in want.items() if v}

    coded = stages["bpe"](spark, mixed, SF)
    assert coded.count() == sum(got.values()) and "ids" in coded.columns


def test_run_is_all_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and set(out.columns) == {"doc_id", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_nulls_repeats_and_clashing_columns(spark):
    """Rows without an id, repeated ones, null texts and sources, and columns named like those that the stages work with."""
    good = lambda i: f"Here is a usual sentence about the number {i} of things, with some other words in it.\nAnother line says what {i} means to them and why."
    rows = [(1, good(1)), (1, good(1)), (1, good(2)), (None, good(3)), (None, good(3)), (None, good(4)), (7, None), (8, ""), (9, good(1)), (9, "x\n" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("q_row"), F.lit(2).alias("lines"), F.lit(3).alias("th"), F.lit(4).alias("place"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "stage")
        assert docs.columns == columns, name
        if name == "quality_rules":
            assert sorted(r["text"] for r in docs.collect()) == sorted(t for _, t in rows if t and t.startswith("Here"))
        if name == "simhash_near_dedup":
            assert sorted((str(r["doc_id"]) for r in docs.filter("text like '%usual%'").collect())) == ["1", "1", "None", "None", "None"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
