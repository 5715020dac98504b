"""BPE encoding and decoding: speculate, verify, and merge exactly only where that fails.

A word's tokens are proposed by greedy longest match. The proposal is the true encoding if every
token is what its own text merges to and every two neighbours are compatible: no merge that exists
would have joined a piece of the left one to a piece of the right one before both were complete.
Both are looked up in numpy arrays for all new words of a batch at once. Words that fail are merged
exactly, lowest rank first, with a heap.

Texts are encoded as the tokenizers library does it with the given file: strings of special tokens
become those tokens, the rest is composed (NFC), lower-cased letter by letter and split by the
file's pattern; white space is dropped. A null text is read as empty and has no tokens. A text of
any length is encoded whole; rows come back in the order and number that they came in. Decoding
joins token strings with one space, as the library does for a file without a decoder.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm.common import table

NEVER = 2**40
#: Words kept per Python worker, and characters encoded at a time; both bound memory only.
CACHE_WORDS, CHUNK_CHARS = 500_000, 1_000_000
#: Letters up to which a word's merges are found by scanning its pairs.
SHORT = 48
END = "</w>"


def byte_letters() -> str:
    """The printable letter that stands for each byte: itself where it is printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in printable else chr(next(spare)) for b in range(256))


BYTES = dict(enumerate(byte_letters()))


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


# Letters and digits that are younger than Unicode 16, which the tokenizers library takes for neither,
# and capitals of Unicode 16 and 17, which it lower-cases and Python doesn't.
NEWER = (
    "0558 058b-058c 088f 0c5c 0cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee "
    "11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 "
    "1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 "
    "1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, **{c: c + 32 for c in range(0x10D50, 0x10D66)}, **{c: c + 27 for c in range(0x16EA0, 0x16EB9)}}


def newer_letters() -> regex.Pattern:
    spans = [x.split("-") for x in NEWER.split()]
    return regex.compile("[" + "".join(f"\\U{int(x[0], 16):08x}-\\U{int(x[-1], 16):08x}" for x in spans) + "]")


class Vocabulary:
    """A tokenizer file, made ready for speculation and verification."""

    def __init__(self, spec: str) -> None:
        file = json.loads(spec)
        model, words = file["model"], file["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or file["decoder"] is not None:
            raise ValueError("a BPE file with word ends and without a decoder is needed")
        self.pattern = regex.compile(words["pattern"]["Regex"])
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        vocab: dict[str, int] = model["vocab"]
        n = max([*vocab.values(), *self.specials.values()]) + 1
        strings = [""] * n
        for s, i in chain(vocab.items(), self.specials.items()):
            strings[i] = s
        self.strings = pa.array(strings)
        self.inner = {s: i for s, i in vocab.items() if not s.endswith(END)}
        self.last = {s.removesuffix(END): i for s, i in vocab.items() if s.endswith(END)}
        self.longest: dict[str, int] = {}  # by the first two letters
        for x in chain(self.inner, self.last):
            self.longest[x[:2]] = max(self.longest.get(x[:2], 1), len(x))
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.ranks = {(a, b): (r, c) for r, (a, b, c) in enumerate(pairs)}
        self.size = n
        self._spines(pairs)
        self.newer = newer_letters()
        self.words: dict[str, tuple[int, ...]] = {}
        self.merged_words = 0

    def _spines(self, pairs: Sequence[tuple[int, int, int]]) -> None:
        """right[t]: t, its right part, that one's right part and so on, each with the rank at which it is used up. left[t] likewise."""
        n = self.size
        rank, right, left = np.full(n, -1, np.int64), [[(t, NEVER)] for t in range(n)], [[(t, NEVER)] for t in range(n)]
        grows = True
        for r, (a, b, c) in enumerate(pairs):
            grows &= bool(rank[a] < r and rank[b] < r and rank[c] < 0)
            rank[c] = r
            right[c] = [(c, NEVER), (b, r), *right[b][1:]]
            left[c] = [(c, NEVER), (a, r), *left[a][1:]]

        def padded(spines: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
            depth = max(map(len, spines))
            filled = np.array([s + [(-1, -1)] * (depth - len(s)) for s in spines], np.int64)
            return np.ascontiguousarray(filled[:, :, 0].T), np.ascontiguousarray(filled[:, :, 1].T)

        self.right, self.right_until = padded(right)
        self.left, self.left_until = padded(left)
        a, b, c = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        codes = a * n + b
        order = np.argsort(codes, kind="stable")
        self.codes, self.code_ranks = codes[order], order.astype(np.int64)
        # a token is sound if no other merge splits it up before its own last one
        sound = np.ones(n, bool)
        sound[c] = self.compatible(a, b, rank[c])
        for x, y, z in pairs:
            sound[z] &= sound[x] and sound[y]
        self.sound = sound & grows

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair, that no merge joins a piece at the end of ``a`` to one at the start of ``b`` while both exist.

        ``until``: the rank at which the two tokens themselves are used up; never, if it isn't given.
        """
        ok = np.ones(len(a), bool)
        for i in range(len(self.right)):
            if not (self.right[i][a] >= 0).any():
                break
            for j in range(len(self.left)):
                x, y = self.right[i][a], self.left[j][b]
                at = np.flatnonzero(ok & (x >= 0) & (y >= 0))
                if not len(at):
                    break
                code = x[at] * self.size + y[at]
                found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                rank = np.where(self.codes[found] == code, self.code_ranks[found], NEVER)
                x_until = self.right_until[i][a[at]] if i or until is None else until[at]
                y_until = self.left_until[j][b[at]] if j or until is None else until[at]
                # equal ranks are the same merge of three equal pieces, where the left one goes first
                not_last = (y_until < NEVER) & (j > 0)
                ok[at[(rank < x_until) & ((rank < y_until) | (not_last & (rank == y_until)))]] = False
        return ok

    def _propose(self, letters: str) -> list[int]:
        out, at, n = [], 0, len(letters)
        inner, last, longest = self.inner, self.last, self.longest
        while at < n:
            end = min(n, at + longest.get(letters[at : at + 2], 1))
            token = last.get(letters[at:]) if end == n else inner.get(letters[at:end])
            while token is None:
                end -= 1
                token = inner.get(letters[at:end])
                if end == at:
                    raise ValueError(f"no token for {letters[at]!r}")
            out.append(token)
            at = end
        return out

    def merged(self, letters: str) -> list[int]:
        """The exact encoding of a word: the merge of lowest rank first, the leftmost of equal ones."""
        tokens = [self.inner[x] for x in letters[:-1]] + [self.last[letters[-1]]]
        if len(tokens) <= SHORT:  # a scan of a few pairs is faster than a heap of them
            ranks, none = self.ranks, (NEVER, -1)
            pairs = [ranks.get(p, none) for p in zip(tokens, tokens[1:], strict=False)]
            while pairs:
                best = min(pairs)
                if best is none:
                    break
                i = pairs.index(best)
                tokens[i : i + 2] = [best[1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = ranks.get((tokens[i - 1], tokens[i]), none)
                if i < len(pairs):
                    pairs[i] = ranks.get((tokens[i], tokens[i + 1]), none)
            return tokens
        after, before = [*range(1, len(tokens)), -1], [*range(-1, len(tokens) - 1)]
        heap = [(self.ranks[p][0], i, *p) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j < 0 or tokens[j] != b:
                continue
            tokens[i], tokens[j], after[i] = self.ranks[a, b][1], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (tokens[k], tokens[after[k]])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[p][0], k, *p))
        return [t for t in tokens if t >= 0]

    def learn(self, words: set[str]) -> None:
        """Encode words that aren't known yet and remember them."""
        new = [w for w in words if w not in self.words]
        if not new:
            return
        # printable ASCII stands for itself
        letters = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(BYTES) for w in new]
        proposed = [self._propose(x) for x in letters]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(new)), lengths)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        fits = self.compatible(pairs // self.size, pairs % self.size)[back]
        failed = np.zeros(len(new), bool)
        failed[owner[~self.sound[flat]]] = True
        failed[owner[inside[~fits]]] = True
        for i in np.flatnonzero(failed):
            proposed[i] = self.merged(letters[i])
        self.merged_words += int(failed.sum())
        self.words.update(zip(new, map(tuple, proposed), strict=True))

    def split(self, text: str) -> list[str]:
        """Words of a text, and strings of special tokens, which no word equals."""
        if not self.special or not any(s in text for s in self.specials):
            return self._words(text)
        parts = self.special.split(text)
        return list(chain.from_iterable([p] if i % 2 else self._words(p) for i, p in enumerate(parts)))

    def _words(self, text: str) -> list[str]:
        # a capital sigma is lower-cased without regard to where in its word it is
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if latin(text):
            return self.pattern.findall(text)
        text = text.translate(CAPITALS)
        if not self.newer.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.newer.sub("\u0378", text))]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts one after another, and how many each has."""
        split = [self.split(t) for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        self.words |= {s: (i,) for s, i in self.specials.items()}
        self.learn(set(chain.from_iterable(split)))
        ids = [list(chain.from_iterable(map(self.words.__getitem__, ws))) for ws in split]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum())), counts

    def decode(self, ids: pa.ListArray) -> pa.Array:
        tokens = pa.ListArray.from_arrays(ids.offsets, pc.take(self.strings, ids.values))
        return pc.binary_join(tokens, " ")


_loaded: dict[int, Vocabulary] = {}


def vocabulary(spec: str) -> Vocabulary:
    """One per Python worker and file."""
    if (key := hash(spec)) not in _loaded:
        _loaded[key] = Vocabulary(spec)
    return _loaded[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def shared(spark: SparkSession, path: str | None) -> Broadcast:
    """The tokenizer file's text; executors need not see the driver's disk. It has the size of a vocabulary, whatever the input's."""
    return spark.sparkContext.broadcast(Path(path or default_path()).read_text(encoding="utf-8"))


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``CHUNK_CHARS`` characters, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(sizes):
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + CHUNK_CHARS, "right")))
        yield start, end
        start = end


def listed(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))


def bpe_encode(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", path: str | None = None, decoded: bool = False) -> DataFrame:
    """``keys`` and ``ids`` (array of int) of each row; with ``decoded`` also the text that the ids decode to, read back from them."""
    spec = shared(docs.sparkSession, path)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(spec.value)
        for batch in batches:
            texts = batch.column(len(keys))
            for start, end in pieces(texts):
                ids = listed(*v.encode([t or "" for t in texts.slice(start, end - start).to_pylist()]))
                columns = [batch.column(i).slice(start, end - start) for i in range(len(keys))] + [ids]
                yield pa.RecordBatch.from_arrays(columns + [v.decode(ids)] * decoded, names=[*keys, "ids"] + ["decoded"] * decoded)

    return docs.select(*keys, F.col(text).alias("bpe_text")).mapInArrow(run, f"{fields}, ids array<int>" + ", decoded string" * decoded)


def bpe_decode(coded: DataFrame, keys: Sequence[str] = ("doc_id",), ids: str = "ids", path: str | None = None) -> DataFrame:
    """``keys`` and ``decoded``, the text of ``ids``; null ids are read as none."""
    spec = shared(coded.sparkSession, path)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.select(*keys).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(spec.value)
        for batch in batches:
            column = batch.column(len(keys))
            own = pa.ListArray.from_arrays(column.offsets, column.values)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keys))] + [v.decode(own)], names=[*keys, "decoded"])

    known = F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("bpe_ids")
    return coded.select(*keys, known).mapInArrow(run, f"{fields}, decoded string")


def digests(coded: DataFrame, keys: Sequence[str]) -> DataFrame:
    return coded.select(
        *keys, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe_encode(table(spark, sf_dir, "documents"), decoded=True), ["doc_id"])
