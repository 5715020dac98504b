"""Personal data by bootstrapped contextual extraction.

Four patterns (email, ip, card, phone) find the seeds. A fifth kind, secret, starts from ``EXAMPLES``
different strings (those with the smallest hashes) of the assigned and quoted ones of ``SECRET_LENGTH``
characters or more that mix letters with digits; all others have to be found by what those few teach.
Every other token with a digit or an at sign is a candidate, groups of digits joined by single blanks,
dots, slashes or hyphens count as one token. Seeds and candidates carry the lexical patterns that they
stand in: the two tokens before them, the tokens on either side, the same with one left out, and the token
before with the form of what it leads to.

First, a pattern is believed for a kind if ``SUPPORT`` different seeds stand in it and they make up
``TRUSTED`` of what speaks for or against it; candidates of a shape that the kind's seeds have say nothing
yet, all others speak against it. What it holds of such a shape becomes known. Then patterns and instances
make up a graph with edge counts, which Spark scores in rounds until the trusted patterns stay the same: a
pattern's score for a kind is the share of its occurrences that instances known for that kind account for,
and an instance's is the best of its patterns'. Patterns that reach ``TRUSTED`` and stand on ``SUPPORT``
different instances mark the candidates they hold; all of these spans are added to the seeds', which all
stay. What has the whole form of a kind and fails its check (a card number that Luhn's rule refutes) counts
against its patterns and is never marked.

Offsets are in code points, ends exclusive. Instances, shapes and patterns are known by 64-bit hashes of
their whole strings. A null text is read as empty. Rows are kept apart even if they are equal or share a
doc_id. Candidates never overlap seeds. An empty table gives no rows.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm.common import materialize, table, workspace

KINDS = ("email", "ip", "card", "phone", "secret")
BASE, SECRET = 4, 4
ROUNDS, TRUSTED, SUPPORT, SMOOTH = 12, 0.8, 5, 1.0
#: Kinds of mentions that are no seeds: open ones, and those that a check has refuted.
OPEN, REFUTED = -1, -2
SECRET_LENGTH, EXAMPLES = 20, 20

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits does: from inside the run the rest is the same, so a failure there is one here.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
QUOTED = re.compile(r"""["'`]([A-Za-z0-9+/_=.-]{20,})["'`]""")
TOKEN = re.compile(r"""[^\s"'`<>|,;=]+|=""")
CANDIDATE = re.compile(r"""[0-9]+(?:[ ./-][0-9]+)+(?![^\s"'`<>|,;])|[^\s"'`<>|,;]+""")
MARKED = re.compile(r"[0-9@]")
DIGITS = re.compile(r"[0-9]")
LETTERS = re.compile(r"[^\W\d_]")
RUNS = re.compile(r"(.)\1+")
LOCAL_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from one at sign to the next: no run of letters is read twice."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_LETTERS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            end = max(end, at + 1)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    found = [(0, a, b) for a, b in emails(text)]
    if DIGITS.search(text):
        small = lambda d: int(d.lstrip("0")[:4] or 0) <= 255
        found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(small, m.group().split(".")))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Quoted strings behind an equals sign or a colon that mix letters with at least four digits."""
    for m in QUOTED.finditer(text):
        said = m.group(1)
        if len(said) >= SECRET_LENGTH and len(DIGITS.findall(said)) >= 4 and LETTERS.search(said):
            at = m.start()
            while at and text[at - 1] in " \t":
                at -= 1
            if at and text[at - 1] in "=:":
                yield m.start(1), m.end(1)


def refuted(word: str) -> bool:
    """Whether a token has the whole form of a kind; as it is no seed, the kind's check has failed."""
    digits = sum(c in "0123456789" for c in word)
    return bool(IP.fullmatch(word) or PHONE.fullmatch(word) or (CARD.fullmatch(word) and 16 <= digits <= 19))


def form(word: str) -> str:
    """Digits as 9 and letters as a, runs of them cut to one, and how many characters there are, in powers of two."""
    return f"{RUNS.sub(lambda m: m.group(1) + '+', LETTERS.sub('a', DIGITS.sub('9', word)))} {len(word).bit_length()}"


def shape(word: str) -> str:
    """Which kinds of characters a token has, and how many, in powers of two."""
    return "".join(sorted({"9" if c in "0123456789" else "a" if c.isalpha() else c for c in word})) + f" {len(word).bit_length()}"


def contexts(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, str, str]]:
    """The two tokens before each span and the one after it, lower-cased, digits as 9. ``spans`` come by start; the text is read once."""
    before, after = [("^", "^")] * len(spans), ["$"] * len(spans)
    by_end = sorted(range(len(spans)), key=lambda i: spans[i][1])
    i = j = 0
    two = one = None
    clean = lambda at: DIGITS.sub("9", text[at[0] : at[1]].lower()) if at else "^"
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while i < len(spans) and spans[i][0] < end:
            cut = (max(start, spans[i - 1][1] if i else 0), spans[i][0])  # what the same token has before the span, back to the one before it
            before[i] = (clean(one), clean(cut)) if cut[0] < cut[1] else (clean(two), clean(one))
            i += 1
        while j < len(spans) and spans[by_end[j]][1] <= start:
            after[by_end[j]] = clean((start, end))
            j += 1
        if i == j == len(spans):
            break
        two, one = one, (start, end)
    for k in range(i, len(spans)):
        before[k] = (clean(two), clean(one))
    return [(*b, a) for b, a in zip(before, after, strict=True)]


def patterns(word: str, two: str, one: str, after: str) -> tuple[str, ...]:
    return f"B {two} {one}", f"A {one} {after}", f"S {two} {after}", f"F {one} {form(word)}"


def mentions(text: str, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, tuple[str, ...]]]:
    """(kind, start, end, instance, patterns) of seeds and candidates, by start."""
    found = sorted((a, b, k) for k, a, b in seeds)
    if MARKED.search(text):
        taken, i, more = list(found), 0, []
        for m in CANDIDATE.finditer(text):
            word = m.group()
            if not MARKED.search(word):
                continue
            a = m.start() + len(word) - len(word.lstrip("([{=:.!?*#$%&"))
            b = m.end() - len(word) + len(word.rstrip(")]}=:.!?*#$%&"))
            if (cut := text.rfind("=", a, b)) >= 0:  # name=value
                a = cut + 1
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if a < b and MARKED.search(text, a, b) and not any(x < b and a < y for x, y, _ in taken[i : i + 5]):
                more.append((a, b, REFUTED if refuted(text[a:b]) else OPEN))
        found = sorted(found + more)
    around = contexts(text, [(a, b) for a, b, _ in found]) if found else []
    return [(k, a, b, text[a:b].lower(), patterns(text[a:b], *c)) for (a, b, k), c in zip(found, around, strict=True)]


def scanned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row, without its text: the key, its base seeds' spans and its mentions."""
    kind = docs.schema[key].dataType.simpleString()
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    mention = pa.struct([*span, ("instance", pa.int64()), ("shape", pa.int64()), ("patterns", pa.list_(pa.int64()))])
    code = lambda x: xxhash.xxh64_intdigest(x) - 2**63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, said = [], []
            for t in batch.column(1):
                body = t.as_py() or ""
                base = base_spans(body)
                held = sorted((a, b) for _, a, b in base)
                seeds = base + [(SECRET, a, b) for a, b in secrets(body) if not any(x < b and a < y for x, y in held)]
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                said.append([{"kind": k, "start": a, "end": b, "instance": code(i), "shape": code(shape(i)), "patterns": list(map(code, p))} for k, a, b, i, p in mentions(body, seeds)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span)), pa.array(said, pa.list_(mention))], names=["key", "seeds", "mentions"])

    fields = "kind:int,start:int,end:int"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(run, f"key {kind}, seeds array<struct<{fields}>>, mentions array<struct<{fields},instance:bigint,shape:bigint,patterns:array<bigint>>>")


def shaped_patterns(occurrences: DataFrame) -> DataFrame:
    """(pattern, shape, kind): what may be believed before any candidate is known. ``occurrences``: pattern, instance, shape, kind."""
    edges = occurrences.groupBy("pattern", "instance", "shape", "kind").agg(F.count("*").alias("n"))
    seeds = edges.filter("kind >= 0")
    shapes = seeds.groupBy(F.col("kind").alias("k"), "shape").agg(F.count_distinct("instance").alias("instances")).filter(F.col("instances") >= SUPPORT).select("k", "shape", F.lit(True).alias("known"))
    held = seeds.groupBy("pattern", F.col("kind").alias("k")).agg(F.sum("n").alias("mass"), F.count_distinct("instance").alias("support")).filter(F.col("support") >= SUPPORT)
    # a pattern's occurrences by what they are: few rows, however often it occurs
    kinds = edges.groupBy("pattern", "shape", "kind").agg(F.sum("n").alias("n"))
    met = held.join(kinds, "pattern").join(shapes, ["k", "shape"], "left")
    silent = (F.col("kind") == F.col("k")) | ((F.col("kind") == OPEN) & F.col("known").isNotNull())
    weighed = met.groupBy("pattern", "k").agg(F.max("mass").alias("mass"), F.sum(F.when(silent, 0).otherwise(F.col("n"))).alias("against"))
    trusted = weighed.filter(F.col("mass") / (F.col("mass") + F.col("against") + SMOOTH) >= TRUSTED).select("pattern", "k")
    return trusted.join(shapes, "k").select("pattern", "shape", F.col("k").alias("kind"))


def trusted_patterns(occurrences: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """(pattern, kind) that are to be believed. ``occurrences``: pattern, instance, kind (below 0: not a seed). ``learned``
    (instance, k): candidates that are known already, each of one kind.

    Each round weighs an edge by how sure its instance is of a kind: 1 for a seed, 0 for what a check has
    refuted, else the best score among its patterns so far. Rounds end when the trusted patterns stay the same.
    """
    spark = occurrences.sparkSession
    with workspace(spark) as work:
        edges = work.keep(occurrences.groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n")), "edges")
        totals = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
        sure = edges.filter("kind >= 0").select("pattern", "instance", F.col("kind").alias("k"), "n", F.lit(1.0).alias("p"))
        open_ = edges.filter(F.col("kind") == OPEN).select("pattern", "instance", "n")
        if learned is not None:
            sure = work.keep(sure.unionByName(open_.join(learned, "instance").select("pattern", "instance", "k", "n", F.lit(1.0).alias("p"))), "sure")
            open_ = work.keep(open_.join(learned, "instance", "left_anti"), "open")
        known, mark = sure, None
        for _ in range(ROUNDS):
            mass = known.groupBy("pattern", "k").agg(F.sum(F.col("n") * F.col("p")).alias("mass"), F.sum(F.when(F.col("p") >= TRUSTED, 1).otherwise(0)).alias("support"))
            scored = mass.join(totals, "pattern").select("pattern", "k", (F.col("mass") / (F.col("total") + SMOOTH)).alias("score"), "support")
            best = work.keep(scored.filter((F.col("score") >= TRUSTED) & (F.col("support") >= SUPPORT)), "patterns")
            now = tuple(best.agg(F.count("*"), F.bit_xor(F.xxhash64("pattern", "k"))).first())
            if now == mark:
                break
            mark = now
            told = open_.join(best.select("pattern", "k", "score"), "pattern").groupBy("instance", "k").agg(F.max("score").alias("p"))
            known = work.keep(sure.unionByName(open_.join(told, "instance").select("pattern", "instance", "k", "n", "p")), "known")
        else:
            warnings.warn(f"patterns still changed after {ROUNDS} rounds", stacklevel=2)
        return materialize(best.groupBy("pattern").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("kind")), "trusted")


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, spans, n_learned) of each row: arrays of (kind, start, end); ``spans`` also has secrets and what the contexts
    added, which ``n_learned`` counts."""
    rows = materialize(scanned(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "mentions")
    said = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    examples = materialize(said.filter(F.col("kind") == SECRET).select("instance").distinct().orderBy("instance").limit(EXAMPLES).withColumn("example", F.lit(True)), "examples")
    kind = F.when((F.col("kind") == SECRET) & F.col("example").isNull(), OPEN).otherwise(F.col("kind"))
    named = said.join(F.broadcast(examples), "instance", "left").withColumn("kind", kind).drop("example")  # at most EXAMPLES rows
    each = named.select("row", "kind", "start", "end", "instance", "shape", F.explode("patterns").alias("pattern"))
    shaped = materialize(shaped_patterns(each), "shaped")
    open_ = each.filter(F.col("kind") == OPEN)
    early = open_.join(shaped.withColumnRenamed("kind", "told"), ["pattern", "shape"])
    learned = materialize(early.groupBy("instance").agg(F.min("told").alias("k")), "learned")
    best = trusted_patterns(each.select("pattern", "instance", "kind"), learned).withColumnRenamed("kind", "told")
    late = open_.join(best, "pattern")
    span = ["row", "start", "end"]
    told = early.select(*span, "told").unionByName(late.select(*span, "told")).groupBy(*span).agg(F.min("told").alias("kind")).withColumn("new", F.lit(True))
    own = named.filter(F.col("kind") == SECRET).select(*span, "kind", F.lit(False).alias("new"))
    added = told.unionByName(own).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"), F.count_if("new").alias("n_learned")).withColumnRenamed("row", "r")
    joined = rows.join(added, F.col("row") == F.col("r"), "left")
    spans = F.when(F.col("more").isNull(), F.col("seeds")).otherwise(F.concat("seeds", "more"))
    return joined.select(F.col("key").alias(key), F.col("seeds").alias("base"), spans.alias("spans"), F.coalesce("n_learned", F.lit(0)).alias("n_learned"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents"))

    def counted(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    every = F.size("spans").cast("long")
    return found.select("doc_id", *map(counted, range(BASE)), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), every.alias("n_spans"), (every - F.size("base")).alias("n_added"), "n_learned")
