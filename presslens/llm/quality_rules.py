"""Quality rules as weak supervision, in DataFrame operations only.

Each rule votes that a document is good (1) or bad (-1), or abstains (0). How far a rule can be
trusted is not set by hand: expectation-maximisation over the counts of vote patterns estimates
every rule's accuracy, and a document is kept if its posterior probability of being good reaches
``KEEP_AT``. Two things make the answer identifiable: the prior odds are even, and a rule is better
than a coin; so a lone vote decides, and learned accuracies decide where votes disagree. The E-step is a column expression over
the pattern table, whose size is bounded by the number of rules; the M-step is one aggregation.

A null text is read as empty: no words, base_failed, not kept. Ties at ``KEEP_AT`` are kept.
An empty table gives no rows. Repeated rows are judged alike, each on its own. Windows of words are
compared by their 64-bit hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm.common import WORD, materialize, table, text_or_empty

#: Characters that count as symbols, as a class of a regular expression.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
KEEP_AT = 0.5


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the counts that the rules read, in columns that start with ``q_``.

    Repeated windows are found inside the row: hashes of all windows, then, only where one of them
    repeats, a sort that brings equal windows together. Nothing is exploded or shuffled.
    """
    body, c = text_or_empty(text), F.col
    # one pass of byte searches each; a split at a single character needs no regular expression
    spaced = body
    for gap in "\t\n\x0b\f\r":
        spaced = F.replace(spaced, F.lit(gap), F.lit(" "))
    others = [F.col(x) for x in docs.columns if x != text]
    df = docs.select(*others, body.alias("q_text"), spaced.alias("q_spaced"))
    # what is counted in the text itself comes first, so that the text goes no further
    df = df.select(
        *others,
        F.array_remove(F.split("q_spaced", " "), "").alias("q_words"),
        F.filter(F.split("q_text", "\n"), lambda x: x.rlike(WORD)).alias("q_lines"),
        F.length(F.replace("q_spaced", F.lit(" "), F.lit(""))).cast("long").alias("q_word_chars"),
        F.regexp_count("q_text", F.lit(SYMBOLS)).cast("long").alias("q_n_symbols"),
        F.regexp_count("q_text", F.lit(r"\p{Lu}")).cast("long").alias("q_n_upper"),
        (F.length("q_text") - F.length(F.replace("q_text", F.lit("!"), F.lit("")))).cast("long").alias("q_n_shouts"),
    )
    counted = [*others, c("q_word_chars"), c("q_n_symbols"), c("q_n_upper"), c("q_n_shouts")]
    starts = F.when(F.size("q_words") >= WINDOW, F.slice("q_words", F.lit(1), F.size("q_words") - (WINDOW - 1))).otherwise(F.array().cast("array<string>"))
    df = df.select(
        *counted,
        F.size("q_words").cast("long").alias("q_n_words"),
        F.size(F.array_distinct("q_words")).cast("long").alias("q_n_distinct"),
        F.size("q_lines").cast("long").alias("q_n_lines"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("q_n_dup_lines"),
        F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get("q_words", i + k) for k in range(1, WINDOW)])).alias("q_windows"),
    )
    counted += [c("q_n_words"), c("q_n_distinct"), c("q_n_lines"), c("q_n_dup_lines")]
    repeats = F.size("q_windows") > F.size(F.array_distinct("q_windows"))
    df = df.select(*counted, F.when(repeats, F.sort_array(F.transform("q_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))).alias("q_sorted"))
    same = lambda x, i: (F.get("q_sorted", i - 1)["w"] == x["w"]) | (F.get("q_sorted", i + 1)["w"] == x["w"])
    at = F.sort_array(F.transform(F.filter("q_sorted", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))
    # each window adds the words that the one before it doesn't cover
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"]
    return df.select(*counted, F.coalesce(covered, F.lit(0)).cast("long").alias("q_n_repeat_words"))


@dataclass(frozen=True)
class Rule:
    """Votes ``vote`` where ``when`` holds and abstains elsewhere."""

    name: str
    vote: int
    when: Column


def rules() -> list[Rule]:
    """Rules of one side each: what a rule doesn't find says nothing, so that one kind of junk isn't outvoted by rules for other kinds."""
    c = F.col
    words, chars = F.greatest(c("q_n_words"), F.lit(1)), F.greatest(c("q_word_chars"), F.lit(1))
    symbols, upper, repeats = c("q_n_symbols") / words, c("q_n_upper") / chars, c("q_n_repeat_words") / words
    variety, dup = c("q_n_distinct") / words, c("q_n_dup_lines") / F.greatest(c("q_n_lines"), F.lit(1))
    length, enough = chars / words, c("q_n_words") >= 10
    plain = enough & (symbols <= 0.05) & (upper <= 0.2)
    return [
        Rule("symbols", -1, symbols > 0.2),
        Rule("upper_case", -1, enough & (upper > 0.4)),
        Rule("shouting", -1, c("q_n_shouts") / words > 0.3),
        Rule("repeated_windows", -1, repeats > 0.2),
        Rule("few_distinct_words", -1, enough & (variety < 0.2)),
        Rule("repeated_lines", -1, dup > 0.5),
        Rule("word_length", -1, (length < 2) | (length > 15)),
        Rule("too_short", -1, c("q_n_words") < 5),
        Rule("varied_words", 1, plain & (variety >= 0.35)),
        Rule("little_repeated", 1, plain & (repeats <= 0.1) & (dup <= 0.2)),
        Rule("usual_words", 1, plain & (length >= 3) & (length <= 10) & (variety >= 0.3)),
    ]


@dataclass(frozen=True)
class Trust:
    """The prior share of good documents, and the accuracy of each rule that expectation-maximisation found."""

    good: float
    accuracy: tuple[float, ...]

    def probability(self, votes: str) -> Column:
        """That a document with these votes is good. Its log odds are the prior's, and for or against them those of every rule that voted.

        The numbers enter as one array, so that the code generated for each round is the same.
        """
        odds = F.array(*[F.lit(math.log(x / (1 - x))) for x in (self.good, *self.accuracy)])
        terms = F.zip_with(F.concat(F.array(F.lit(1)), F.col(votes)), odds, lambda v, o: v * o)
        return 1 / (1 + F.exp(-F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def fit(patterns: DataFrame, n_rules: int, rounds: int | None = None, start: float = 0.8, strength: float = 5.0, tolerance: float = 1e-3, prior: float = 0.5) -> Trust:
    """``patterns`` has ``votes``, an array by rule, and ``n``, how many documents vote so.

    Rounds go on until no accuracy moves by ``tolerance`` (each raises the penalised likelihood, so they
    settle); ``rounds`` ends them sooner. ``strength`` documents at accuracy ``start`` are added for each rule, so that rules which hardly
    vote keep a usable accuracy and an empty table gives the start.
    """
    trust = Trust(prior, (start,) * n_rules)
    vote = lambda i: F.get("votes", F.lit(i))
    for done in count(1):
        weighed = patterns.withColumn("p", trust.probability("votes"))
        right = [F.sum(F.when(vote(i) > 0, F.col("n") * F.col("p")).when(vote(i) < 0, F.col("n") * (1 - F.col("p")))).alias(f"right_{i}") for i in range(n_rules)]
        voted = [F.sum(F.col("n") * F.abs(vote(i))).alias(f"voted_{i}") for i in range(n_rules)]
        m = weighed.agg(*right, *voted).first()
        share = [((m[f"right_{i}"] or 0) + strength * start) / ((m[f"voted_{i}"] or 0) + strength) for i in range(n_rules)]
        new = Trust(prior, tuple(min(max(x, 0.55), 0.99) for x in share))
        moved = max(abs(a - b) for a, b in zip(new.accuracy, trust.accuracy, strict=True))
        trust = new
        if moved < tolerance or done == rounds:
            break
    return trust


def with_votes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("q_votes", F.array(*[F.when(r.when, F.lit(r.vote)).otherwise(0) for r in rules()]))


def judged(counts: DataFrame) -> DataFrame:
    """``counts``, a written table, with base_failed, quality and kept."""
    named = with_votes(counts)
    patterns = materialize(named.groupBy(F.col("q_votes").alias("votes")).agg(F.count("*").alias("n")).coalesce(1), "votes")
    quality = fit(patterns, len(rules())).probability("q_votes")
    failed = (F.col("q_n_words") < 10) | (100 * F.col("q_n_repeat_words") > 20 * F.col("q_n_words"))
    return named.withColumn("q_failed", failed).withColumn("q_quality", quality).withColumn("q_kept", ~F.col("q_failed") & (F.col("q_quality") >= KEEP_AT))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, the counts, base_failed, the posterior ``quality`` and kept."""
    # the texts are read once; what is judged from here on is a narrow table
    counts = materialize(measured(docs.select(F.col(key), F.col(text).alias("q_body")), "q_body"), "quality")
    out = {"n_words": "n_words", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "n_dup_lines", "n_repeat_words": "n_repeat_words", "failed": "base_failed", "kept": "kept", "quality": "quality"}
    return judged(counts).select(key, *[F.col(f"q_{a}").alias(b) for a, b in out.items()])


def kept_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. They are written once with their counts, and not shuffled."""
    counts = materialize(measured(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("q_row"), F.col(text).alias("q_body")), "q_body"), "judged")
    return judged(counts).filter("q_kept").select("q_row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).withColumn("quality", F.round("quality", 6))


OP2_SQL = r"""
with recursive split as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), wins as (
  select rid, i, array_to_string(ws[i:i + 4], ' ') as g from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from split)
), twice as (
  select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from wins) where c > 1
), covered as (
  select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 5)) as p from twice) group by rid
), lined as (
  select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from split
), m as (
  select l.rid, doc_id, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, len(list_distinct(ws)) as n_distinct,
    len(regexp_extract_all(t, '\p{Lu}')) as n_upper, length(t) - length(replace(t, '!', '')) as n_shouts
  from lined l left join covered c on c.rid = l.rid
), f as (
  select *, n_symbols / greatest(n_words, 1) as sym, n_upper / greatest(word_chars, 1) as up, n_repeat_words / greatest(n_words, 1) as rep, n_distinct / greatest(n_words, 1) as variety,
    n_dup_lines / greatest(n_lines, 1) as dup, greatest(word_chars, 1) / greatest(n_words, 1) as wl, n_shouts / greatest(n_words, 1) as sh, n_words >= 10 as enough from m
), g as (select *, enough and sym <= 0.05 and up <= 0.2 as plain from f), v as (
  select *, [-(sym > 0.2)::int, -(enough and up > 0.4)::int, -(sh > 0.3)::int, -(rep > 0.2)::int, -(enough and variety < 0.2)::int, -(dup > 0.5)::int, -(wl < 2 or wl > 15)::int, -(n_words < 5)::int,
    (plain and variety >= 0.35)::int, (plain and rep <= 0.1 and dup <= 0.2)::int, (plain and wl >= 3 and wl <= 10 and variety >= 0.3)::int] as votes from g
), patterns as (select votes, count(*) as n from v group by votes), em(r, acc, moved) as (
  select 0, [0.8::double for k in range(1, 12)], 1.0::double
  union all
  select r + 1, list(new order by j), max(abs(new - old)) from (
    select r, j, any_value(acc[j]) as old, least(greatest((sum(n * case when votes[j] > 0 then p when votes[j] < 0 then 1 - p else 0 end) + 4.0) / (sum(n * abs(votes[j])) + 5.0), 0.55), 0.99)::double as new
    from (select r, acc, votes, n, 1 / (1 + exp(-list_sum(list_transform(range(1, 12), lambda k: votes[k] * ln(acc[k] / (1 - acc[k])))))) as p, unnest(range(1, 12)) as j from em, patterns where moved >= 1e-3)
    group by r, j) group by r
), last as (select acc from em order by r desc limit 1), q as (
  select v.*, 1 / (1 + exp(-list_sum(list_transform(range(1, 12), lambda k: votes[k] * ln(acc[k] / (1 - acc[k])))))) as quality, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from v, last
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and quality >= 0.5 as kept, round(quality, 6) as quality from q
"""
