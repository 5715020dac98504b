"""SentencePiece encoding and decoding that keeps offsets.

A text is normalised by the longest rule of the model's compiled character map (a double-array trie)
that matches where it stands; other characters stay as they are. For each byte of the normalised text
the place in the source is recorded that it came from: spaces become the mark U+2581, one mark is put
in front, spaces are collapsed if the model says so, and all of that is carried into the record. BPE
then merges the two neighbours whose joined piece scores best (the leftmost of equal ones), characters
that no piece has fall back to bytes, and every piece is projected to its span of source bytes.

Merges never cross from one character to the next where no piece has the two side by side. Texts are cut
at such places that the model is found to have (before marks, between letters and signs, around line
ends), and the words between them are encoded once and remembered. A model with pieces that have a mark
after another character is encoded without cutting.

A null text is read as empty and has no ids. A text of any length is encoded whole, in memory of about
40 bytes for each of its own. Rows come back in their order and number, equal ones as often as they came.
Of the bytes of a character that falls back, only the last one has a span; that of the others is empty.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator, Sequence
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm.bpe import listed, pieces
from presslens.llm.common import table

MARK, MARK_BYTES = "▁", "▁".encode()
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE_MODEL = 2
#: Words kept per Python worker, the longest that is kept, and up to which length merges are found by scanning.
CACHE_WORDS, KEPT_LENGTH, SHORT = 700_000, 64, 48
NEVER = 2**40


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """The compiled map: a double-array trie of sources, and what each becomes, ended by a zero byte."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.outputs = blob[4 + size :]
        first = [b for b in range(256) if self.units and self.child(self.root(), b) is not None]
        self.first = np.zeros(256, bool)
        self.first[first] = True
        self.second = np.zeros((256, 256), bool)  # pairs of bytes that some rule begins with, or has as its first byte and end
        for b in first:
            node, ends = self.child(self.root(), b)
            self.second[b] = True if ends is not None else [self.child(node, c) is not None for c in range(256)]

    def _offset(self, unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def root(self) -> int:
        return self._offset(self.units[0])

    def child(self, node: int, byte: int) -> tuple[int, int | None] | None:
        """The node below by ``byte``, and the value if a source ends there."""
        at = node ^ byte
        if at >= len(self.units):
            return None
        unit = self.units[at]
        if unit & 0x800000FF != byte:
            return None
        below = at ^ self._offset(unit)
        return below, self.units[below] & 0x7FFFFFFF if unit & 256 else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest source that stands at ``at``, and what it becomes."""
        node, found = self.root(), None
        for i in range(at, len(text)):
            step = self.child(node, text[i])
            if step is None:
                break
            node, value = step
            if value is not None:
                found = i + 1 - at, value
        if found is None:
            return None
        length, value = found
        return length, self.outputs[value : self.outputs.index(b"\0", value)]

    def matches(self, text: bytes, data: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(place, length, what it becomes) of each rule that is used, from left to right."""
        if not self.units or not len(data):
            return []
        after = np.append(data[1:], 0)
        candidates = np.flatnonzero(((data & 0xC0) != 0x80) & self.first[data] & self.second[data, after])
        out, done = [], 0
        for at in candidates.tolist():
            if at >= done and (found := self.longest(text, at)):
                out.append((at, *found))
                done = at + found[0]
        return out


class Normalizer:
    """From source text to normalised bytes, with the source place of each of them."""

    def __init__(self, spec: bytes, suffix: bool = False) -> None:
        known = dict(fields(spec))
        self.map = CharacterMap(known.get(2, b""))
        self.prefix, self.collapse, self.escape = (bool(known.get(i, 1)) for i in (3, 4, 5))
        if suffix or not self.escape:
            raise ValueError("models that mark the ends of words, or leave spaces as they are, aren't supported")

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each and for the end, the source byte where it begins."""
        source = text.encode()
        data = np.frombuffer(source, np.uint8)
        begin = np.flatnonzero((data & 0xC0) != 0x80)
        matched = self.map.matches(source, data)
        where, size, outputs = begin, np.diff(np.append(begin, len(data))), data
        if matched:  # what a rule consumed is one unit; its output stands behind the source
            place, length, out = zip(*matched, strict=True)
            place, length = np.array(place), np.array(length)
            covered = np.zeros(len(data) + 1, np.int64)
            np.add.at(covered, place, 1)
            np.add.at(covered, place + length, -1)
            free = np.cumsum(covered)[:-1][begin] == 0
            out_size = np.array([len(x) for x in out])
            out_at = len(data) + np.concatenate([[0], np.cumsum(out_size)[:-1]])
            outputs = np.concatenate([data, np.frombuffer(b"".join(out), np.uint8)])
            order = np.argsort(np.concatenate([begin[free], place]), kind="stable")
            begin, where, size = (np.concatenate(x)[order] for x in ((begin[free], place), (begin[free], out_at), (size[free], out_size)))
        unit = np.repeat(np.arange(len(begin)), size)
        inside = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
        got, came = outputs[where[unit] + inside] if matched else data, begin[unit]
        space = got == 0x20
        start, end = 0, len(source)
        if self.collapse:
            word = np.maximum.accumulate(np.where(space, -1, np.arange(len(got)))) if len(got) else np.empty(0, np.int64)
            leading = word < np.arange(len(got)) - inside  # nothing but spaces so far in its unit
            keep = ~(space & leading & np.append(True, space[:-1])[: len(got)])
            alone = np.flatnonzero(~(space & np.repeat(size == 1, size)))  # units of one space in front are passed over before the mark
            start = int(came[alone[0]]) if len(alone) else len(source)
            got, came, space = got[keep], came[keep], space[keep]
        if start == end:
            return b"", np.array([end])
        times = np.where(space, 3, 1)
        marked = np.repeat(got, times)
        at = (np.cumsum(times) - times)[space]
        for i, b in enumerate(MARK_BYTES):
            marked[at + i] = b
        came = np.repeat(came, times)
        if self.prefix:
            marked = np.concatenate([np.frombuffer(MARK_BYTES, np.uint8), marked])
            came = np.concatenate([np.full(3, start), came])
        out, came = marked.tobytes(), np.append(came, end)
        size = len(out)
        while self.collapse and out.endswith(MARK_BYTES, 0, size):
            size -= 3
        return out[:size], came[: size + 1]


class Pieces:
    """A model file, ready to encode and decode."""

    def __init__(self, model: bytes) -> None:
        entries, trainer, spec = [], {}, b""
        for number, value in fields(model):
            if number == 1:
                e = dict(fields(value))
                entries.append((e[1].decode(), struct.unpack("<f", e.get(2, bytes(4)))[0], e.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                spec = value
        if trainer.get(3) != BPE_MODEL or not trainer.get(35) or {k for _, _, k in entries} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a BPE model with byte fallback is needed, without unused and user-defined pieces")
        self.normalize = Normalizer(spec, bool(trainer.get(24, 0)))
        self.ids = {s: i for i, (s, _, k) in enumerate(entries) if k == NORMAL}
        order = {score: r for r, score in enumerate(sorted({s for _, s, k in entries if k == NORMAL}, reverse=True))}
        self.byte_ids = [0] * 256
        self.byte_of, self.length = np.full(len(entries), -1), np.zeros(len(entries), np.int64)
        self.letters = [len(s) for s, _, _ in entries]
        unknown = trainer.get(44, " ⁇ ".encode())
        self.bytes_of: list[bytes] = []
        self.silent = {i for i, (_, _, k) in enumerate(entries) if k == CONTROL}
        self.marked = {i for i, (s, _, k) in enumerate(entries) if k == NORMAL and s.startswith(MARK)}
        for i, (s, _, kind) in enumerate(entries):
            if kind == BYTE:
                self.byte_ids[int(s[3:5], 16)] = i
                self.byte_of[i] = int(s[3:5], 16)
            self.length[i] = len(s.encode())
            self.bytes_of.append({BYTE: bytes([max(0, self.byte_of[i])]), CONTROL: b"", UNKNOWN: unknown}.get(kind, s.replace(MARK, " ").encode()))
        self.table = pa.array(self.bytes_of, pa.binary())
        self._merges(order, {s: score for s, score, k in entries if k == NORMAL})
        self.words_of = self._splitter()
        self.words: dict[str, tuple[int, ...]] = {}

    def _merges(self, order: dict[float, int], scores: dict[str, float]) -> None:
        """merges[left * m + right] is rank * m + piece. Characters without a piece get numbers of their own, from the end of the pieces on."""
        spare = sorted({c for s in self.ids for c in s} - set(self.ids))
        number = self.ids | {c: len(self.length) + i for i, c in enumerate(spare)}
        self.m = m = len(self.length) + len(spare) + 1  # the last number is any other character
        self.numbers, self.merges = {s: i for s, i in number.items() if len(s) == 1}, {}
        for s, i in self.ids.items():
            for cut in range(1, len(s)):
                if (left := number.get(s[:cut])) is not None and (right := number.get(s[cut:])) is not None:
                    self.merges[left * m + right] = order[scores[s]] * m + i
        seen: dict[int, int] = {}
        for s in self.ids:
            seen[order[scores[s]]] = seen.get(order[scores[s]], 0) + 1
        self.tied = {r for r, n in seen.items() if n > 1}

    def _splitter(self):
        """Cuts a normalised text where no piece has both neighbours: before marks, around characters that never merge, and between letters and some signs."""
        inner = {c for s in self.ids if len(s) > 1 for c in s}
        beside = {s[i : i + 2] for s in self.ids for i in range(len(s) - 1)}
        lone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inner)
        if any(MARK in s.lstrip(MARK) for s in self.ids):
            return re.compile(".+", re.DOTALL).findall
        letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100))]
        signs = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c in inner and not any(x + c in beside for x in letters))
        among = "A-Za-z\u00c0-\u00ff"
        word = f"[^{MARK}{among}{lone}]*(?:[{among}]+(?:[^{MARK}{among}{signs}{lone}][^{MARK}{among}{lone}]*)?)*"
        return re.compile((f"[{lone}]|" if lone else "") + f"{MARK}+{word}|(?=[^{MARK}]){word}").findall

    def merged(self, word: str) -> tuple[int, ...]:
        m, merges = self.m, self.merges
        tokens = [self.numbers.get(c, m - 1) for c in word]
        if len(tokens) <= SHORT:
            values = [merges.get(a * m + b, NEVER) for a, b in zip(tokens, tokens[1:], strict=False)]
            while values and (best := min(values)) < NEVER:
                i = values.index(best)
                if best // m in self.tied:  # the leftmost of equal scores
                    i = next(j for j, v in enumerate(values) if v // m == best // m)
                    best = values[i]
                tokens[i : i + 2] = [best % m]
                del values[i]
                if i:
                    values[i - 1] = merges.get(tokens[i - 1] * m + tokens[i], NEVER)
                if i < len(values):
                    values[i] = merges.get(tokens[i] * m + tokens[i + 1], NEVER)
        else:
            after, before = [*range(1, len(tokens)), -1], [*range(-1, len(tokens) - 1)]
            heap = [(v // m, i, p) for i, p in enumerate(a * m + b for a, b in zip(tokens, tokens[1:], strict=False)) if (v := merges.get(p)) is not None]
            heapq.heapify(heap)
            while heap:
                _, i, pair = heapq.heappop(heap)
                j = after[i]
                if j < 0 or tokens[i] < 0 or tokens[i] * m + tokens[j] != pair:
                    continue  # one of the two has been merged since
                tokens[i], tokens[j], after[i] = merges[pair] % m, -1, after[j]
                if after[i] >= 0:
                    before[after[i]] = i
                for k in (before[i], i):
                    if k >= 0 and after[k] >= 0 and (v := merges.get(p := tokens[k] * m + tokens[after[k]])) is not None:
                        heapq.heappush(heap, (v // m, k, p))
            tokens = [t for t in tokens if t >= 0]
        if max(tokens) < len(self.byte_of):
            return tuple(tokens)
        out, at = [], 0  # characters without a piece become their bytes
        for t in tokens:
            if t < len(self.byte_of):
                out.append(t)
                at += self.letters[t]
            else:
                out += [self.byte_ids[b] for b in word[at].encode()]
                at += 1
        return tuple(out)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another, how many each has, and the source bytes where each begins and ends."""
        normal = [self.normalize(t) for t in texts]
        split = [self.words_of(n.decode()) for n, _ in normal]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        known = self.words
        new = set(chain.from_iterable(split)).difference(known)
        known.update((w, self.merged(w)) for w in new)
        ids = [list(chain.from_iterable(map(known.__getitem__, ws))) for ws in split]
        for w in new:
            if len(w) > KEPT_LENGTH:
                del known[w]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
        begins, ends = self.spans(flat, counts, [came for _, came in normal])
        return flat, counts, begins, ends

    def spans(self, flat: np.ndarray, counts: np.ndarray, came: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece begins and ends in its source."""
        byte = self.byte_of[flat]
        size = np.where(byte < 0, self.length[flat], 0)
        # a character in bytes: all of it belongs to its last byte
        goes_on = (byte & 0xC0) == 0x80
        goes_on[byte < 0] = False
        last = np.flatnonzero((byte >= 0) & ~np.append(goes_on[1:], False))
        lead = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(flat)))) if len(flat) else np.empty(0, np.int64)
        size[last] = last - lead[last] + 1
        upto = np.cumsum(size)
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        base = np.repeat(np.where(counts > 0, np.append(upto, 0)[first] - np.append(size, 0)[first], 0), counts)
        shift = np.repeat(np.concatenate([[0], np.cumsum([len(c) for c in came])])[:-1], counts)
        places = np.concatenate(came) if came else np.empty(0, np.int64)
        end = upto - base
        return places[shift + end - size].astype(np.int32), places[shift + end].astype(np.int32)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids. Bytes that aren't UTF-8 become U+FFFD, one for each."""
        joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pc.take(self.table, ids.values)), b"").to_pylist()
        offsets, flat = ids.offsets.to_numpy(), ids.values
        out = []
        for i, raw in enumerate(joined):
            cut, at = 0, int(offsets[i])
            while at < offsets[i + 1] and (self.normalize.prefix or self.normalize.collapse):
                piece = flat[at].as_py()
                if piece in self.silent:
                    at += 1
                    continue
                cut += piece in self.marked
                if not self.normalize.collapse or self.bytes_of[piece] != b" ":
                    break
                at += 1
            body = raw[cut:]
            try:
                out.append(body.decode())
            except UnicodeDecodeError:
                out.append(repaired(body))
        return pa.array(out, pa.string())


def repaired(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        b = raw[at]
        size = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        try:
            out.append(raw[at : at + size].decode() or "�")
        except UnicodeDecodeError:
            out.append("�")
            size = 1
        at += max(1, size)
    return "".join(out)


_loaded: dict[int, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """One per Python worker and model."""
    if (key := hash(model)) not in _loaded:
        _loaded[key] = Pieces(model)
    return _loaded[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def shared(spark: SparkSession, path: str | None) -> Broadcast:
    """The model file; it has the size of a vocabulary, whatever the input's."""
    return spark.sparkContext.broadcast(Path(path or default_path()).read_bytes())


def types_of(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)


def piece_encode(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", path: str | None = None, decoded: bool = False) -> DataFrame:
    """``keys``, ``ids`` and the source bytes ``begins`` and ``ends`` of each piece; with ``decoded`` also the text of the ids, read back from them."""
    model = shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = loaded(model.value)
        for batch in batches:
            texts = batch.column(len(keys))
            for start, end in pieces(texts):
                flat, counts, begins, ends = p.encode([t or "" for t in texts.slice(start, end - start).to_pylist()])
                ids = listed(flat, counts)
                columns = [batch.column(i).slice(start, end - start) for i in range(len(keys))] + [ids, listed(begins, counts), listed(ends, counts)]
                yield pa.RecordBatch.from_arrays(columns + [p.decode(ids)] * decoded, names=[*keys, "ids", "begins", "ends"] + ["decoded"] * decoded)

    return docs.select(*keys, F.col(text).alias("piece_text")).mapInArrow(run, f"{types_of(docs, keys)}, ids array<int>, begins array<int>, ends array<int>" + ", decoded string" * decoded)


def piece_decode(coded: DataFrame, keys: Sequence[str] = ("doc_id",), ids: str = "ids", path: str | None = None) -> DataFrame:
    """``keys`` and ``decoded``, the text of ``ids``; null ids are read as none."""
    model = shared(coded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = loaded(model.value)
        for batch in batches:
            column = batch.column(len(keys))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keys))] + [p.decode(pa.ListArray.from_arrays(column.offsets, column.values))], names=[*keys, "decoded"])

    known = F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("piece_ids")
    return coded.select(*keys, known).mapInArrow(run, f"{types_of(coded, keys)}, decoded string")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text, and the source bytes that the spans of the pieces cover."""
    coded = piece_encode(table(spark, sf_dir, "documents"), decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"),  # an empty text has no pieces
    )
