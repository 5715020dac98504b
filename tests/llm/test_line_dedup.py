from pyspark.sql import functions as F

from presslens.llm import line_dedup

P = ["first line of the shared passage here", "second line of it goes on for a while", "third line ends the passage for good"]
Q = ["another passage that some documents have in common", "with its own second line of words"]


def text(*parts):
    return "\n".join(x for p in parts for x in ([p] if isinstance(p, str) else p))


def cleaned(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit("clash")).repartition(3)
    return {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, **more).collect()}


def test_blocks_go_from_later_documents_only(spark):
    rows = [(1, text("alpha own line", P, "omega own line")), (2, text("beta only here", P, "more beta text")), (3, text(Q, "gamma", P)), (4, text("delta", P, "and", Q)), (5, text("And.", "x"))]
    got = cleaned(spark, rows)
    assert got[1] == rows[0][1]
    assert got[2] == "beta only here\nmore beta text"
    assert got[3] == text(Q, "gamma")
    assert got[4] == "delta\nand"
    assert got[5] == rows[4][1]


def test_moved_repeated_and_spaced_blocks(spark):
    rows = [(1, text(P, "middle of one", Q)), (2, text(Q, "own two", P, "", P, "end two")), (3, text(P[0], "", P[1], "tail"))]
    got = cleaned(spark, rows)
    assert got[2] == "own two\n\nend two"
    assert got[3] == "\ntail"


def test_short_common_lines_stay(spark):
    rows = [(1, "And.\nown text of one"), (2, "And.\nown text of two"), (3, "And.\nwith these\nown text of three"), (4, "x\nAnd.\nwith these\nlast")]
    assert cleaned(spark, rows) == dict(rows)
    assert cleaned(spark, rows, least=3)[4] == "x\nlast"


def test_copies_nulls_ties_and_empty_tables(spark):
    whole = text(P, Q)
    rows = [(1, whole), (2, whole), (2, whole), (3, None), (4, ""), (None, whole), (5, whole + "\nnew words at the end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(docs).collect()), key=str)
    assert got == sorted([(1, whole), (2, ""), (2, ""), (3, None), (4, ""), (0, ""), (5, "new words at the end")], key=str)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_alignment_against_all_common_runs():
    import random

    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(14))] for _ in range(2))
        blocks = line_dedup.common_blocks(a, b)
        firsts = {b.index(h) for h in set(b) & set(a)}
        covered = [j for lo, hi in blocks for j in range(lo, hi)]
        assert sorted(covered) == sorted(firsts)  # every common line is in one block
        for lo, hi in blocks:
            at = a.index(b[lo])
            assert all(a.index(b[lo + k]) == at + k for k in range(hi - lo))
    assert line_dedup.rising([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


def test_every_line_survives_somewhere(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    before = {x for r in docs.collect() for x in r["text"].split("\n") if x.split()}
    after = line_dedup.dedup_lines(docs).collect()
    assert before <= {x for r in after for x in r["text"].split("\n")}
    seen = set()
    for r in sorted(after, key=lambda r: r["doc_id"]):
        mine = {x for x in r["text"].split("\n") if len(x.split()) >= 5}
        assert not mine & seen
        seen |= mine


def brute_doomed(a, b, w, least=5):
    out = set()
    for j in range(len(b)):
        for i in range(len(a)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if sum(w[j : j + k]) >= least:
                out.update(range(j, j + k))
    return sorted(out)


def test_every_common_run_goes_from_repeated_lines():
    import random

    rng = random.Random(5)
    words = [rng.randrange(1, 7) for _ in range(12)]
    for _ in range(2000):
        a, b = ([rng.randrange(rng.choice([3, 12])) for _ in range(rng.randrange(14))] for _ in range(2))
        w = [words[h] for h in b]
        assert line_dedup.doomed(a, b, w) == brute_doomed(a, b, w)


def test_moved_lines_take_time_in_proportion():
    import random
    import time

    n = 200_000
    order = list(range(n))
    random.Random(7).shuffle(order)
    began = time.time()
    for later in (order[::-1], list(range(n))[::-1], order):
        assert line_dedup.doomed(list(range(n)), later, [9] * n) == list(range(n))
    assert line_dedup.doomed(list(range(n)), list(range(n))[::-1], [2] * n) == []
    assert time.time() - began < 40


def test_repeated_lines_go_wherever_they_stand(spark):
    x = "a line of quite some words that is repeated"
    rows = [(1, text("head", x, x, "own one")), (2, text("head", x, "own two", x, x, x, "end", "head"))]
    assert cleaned(spark, rows)[2] == "own two\nend\nhead"


def test_short_lines_with_other_first_holders_are_found(spark):
    lines = [f"line number {i}" for i in range(20)]
    rows = [(i, f"own {i}\n{lines[i]}\nother {i}") for i in range(20)]
    rows += [(20, text("twenty", lines, "end")), (21, text("twenty-one", lines, "stop"))]
    got = cleaned(spark, rows)
    assert got[20] == rows[20][1] and got[21] == "twenty-one\nstop"


def test_linked_runs_cover_every_common_run(spark):
    import random

    rng = random.Random(6)
    rows = [(i, "\n".join(" ".join([f"w{h}"] * (1 + h % 6)) for h in (rng.randrange(14) for _ in range(rng.randrange(12))))) for i in range(80)]
    got = cleaned(spark, rows)
    for i, t in rows:
        b, gone = [x for x in t.split("\n") if x], set()
        for _, e in rows[:i]:
            gone.update(brute_doomed([x for x in e.split("\n") if x], b, [len(x.split()) for x in b]))
        assert got[i] == "\n".join(x for k, x in enumerate(b) if k not in gone)


def test_rows_without_an_id_are_documents_of_their_own(spark, monkeypatch):
    """Each is compared with those before it, also where all share a null or repeated id, and pairs stay in proportion."""
    shared = [f"shared line number {i} of some words" for i in range(4)]
    rows = [(None, text(f"own words of row {i} here", shared[i % 4], f"end of row {i}")) for i in range(40)] + [(7, text("seven has words of its own", shared))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["text"] for r in line_dedup.dedup_lines(docs).collect()]
    assert len(got) == 41 and sum(x in t.split("\n") for t in got for x in shared) == 4  # seven keeps them
    without = [r["text"] for r in line_dedup.dedup_lines(docs.filter("doc_id is null")).collect()]
    assert sum(x in t.split("\n") for t in without for x in shared) == 4  # one row keeps each
    lines = line_dedup.line_table(docs.filter("doc_id is null"))
    assert line_dedup.linked(lines).count() <= 36


def test_three_first_holders_and_two_that_hold_all(spark):
    own = [f"three words {i}" for i in range(3)]
    rows = [(i + 1, text(f"alpha {i} head", own[i], f"tail {i}")) for i in range(3)] + [(10, text("ten", own, "x")), (11, text("eleven", own, "y"))]
    got = cleaned(spark, rows)
    assert got[10] == rows[3][1] and got[11] == "eleven\ny"


def test_whole_operator_against_all_pairs(spark):
    """Every document loses what stands in runs of five words or more of any earlier one: on real documents, all pairs aligned."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    split = {i: [(k, x) for k, x in enumerate(t.split("\n")) if x.split()] for i, t in rows}
    names = {}
    for x in (x for v in split.values() for _, x in v):
        names.setdefault(x, len(names))
    coded = {i: [names[x] for _, x in v] for i, v in split.items()}
    got = {r["doc_id"]: r["lines_gone"] for r in line_dedup.dedup_lines(docs).collect()}
    holders = {}
    for i, _ in rows:
        early = sorted({j for h in coded[i] for j in holders.get(h, ())})
        words, gone = [len(x.split()) for _, x in split[i]], set()
        for j in early:
            gone.update(line_dedup.doomed(coded[j], coded[i], words))
        assert got[i] == sorted(split[i][k][0] for k in gone), i
        for h in coded[i]:
            holders.setdefault(h, set()).add(i)
