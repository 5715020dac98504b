"""Chat formatting by columnar byte assembly.

A turn becomes ``<|role|>``, a newline, its text, ``</s>`` and a newline. Inside roles and texts a
backslash is doubled and a control string gets one after its first character, so that no control
string is left there and reading back undoes exactly that.

Turns are dealt by ranges of conversation, turn, role and the first characters of the text, so a
conversation with a third of all turns is formatted in many tasks, whatever its turns are numbered,
and each of its parts is a row. In a task, a batch of turns is put together in numpy: lengths of all
segments, their cumulative offsets, and a gather of bytes from templates, roles and texts into one
preallocated buffer, ``SLICE`` bytes at a time, which becomes the Arrow column. The loss mask is a list
of (start, end) in code points of that part, one span for each assistant text.

Null texts and roles are read as empty. Turns are ordered by turn (null first), then role and text;
equal rows all count. Rows with a null conv_id make up one conversation. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm.common import table

OPEN, CLOSE, STOP = "<|", "|>\n", "</s>\n"
CONTROLS = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Turns that one output row holds at most, bytes that are gathered at a time, and characters of a text that its range goes by.
PIECE, SLICE, LEADING = 1024, 1 << 20, 32


def escaped(column: pa.Array) -> pa.Array:
    out = pc.replace_substring(column, "\\", "\\\\")
    for control in CONTROLS:
        out = pc.replace_substring(out, control, control[0] + "\\" + control[1:])
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its values."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), at


def assemble(roles: pa.Array, texts: pa.Array, bounds: np.ndarray) -> tuple[pa.Array, list[list[dict[str, int]]]]:
    """Formatted strings for runs of turns (``bounds``: first turn of each run and the end), and the loss spans of each."""
    role, text = escaped(roles), escaped(texts)
    (role_bytes, role_at), (text_bytes, text_at) = bytes_of(role), bytes_of(text)
    fixed = [s.encode() for s in (OPEN, CLOSE, STOP)]
    source = np.concatenate([np.frombuffer(b"".join(fixed), np.uint8), role_bytes, text_bytes])
    base_role = sum(map(len, fixed))
    base_text = base_role + len(role_bytes)
    n, a, b, c = len(role), *map(len, fixed)
    begin = np.column_stack([np.full(n, 0), base_role + role_at[:-1], np.full(n, a), base_text + text_at[:-1], np.full(n, a + b)]).ravel()
    length = np.column_stack([np.full(n, a), np.diff(role_at), np.full(n, b), np.diff(text_at), np.full(n, c)]).ravel()
    put = np.concatenate([[0], np.cumsum(length)])
    out, shift = np.empty(put[-1], np.uint8), begin - put[:-1]
    for low in range(0, len(out), SLICE):  # the indices of a slice, not of everything
        high = min(low + SLICE, len(out))
        x, y = np.searchsorted(put, low, side="right") - 1, np.searchsorted(put, high)
        there = np.minimum(put[x + 1 : y + 1], high) - np.maximum(put[x:y], low)
        out[low:high] = source[np.arange(low, high) + np.repeat(shift[x:y], there)]
    offsets = put[bounds * 5].astype(np.int32)
    strings = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out))])
    # the same again in code points, for the spans
    role_chars, text_chars = (pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (role, text))
    turn_chars = len(OPEN) + role_chars + len(CLOSE) + text_chars + len(STOP)
    start = np.concatenate([[0], np.cumsum(turn_chars)])
    first = np.repeat(start[bounds[:-1]], np.diff(bounds))
    text_start = start[:-1] - first + len(OPEN) + role_chars + len(CLOSE)
    lossy = pc.equal(roles, "assistant").to_numpy(zero_copy_only=False)
    spans = [[{"start": int(text_start[i]), "end": int(text_start[i] + text_chars[i])} for i in range(lo, hi) if lossy[i]] for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return strings, spans


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, part, piece, formatted, loss): the parts of each conversation, in order of part and piece."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, LEADING)).sortWithinPartitions("conv_id", "turn", "role", "text")
    placed = dealt.select("conv_id", F.spark_partition_id().cast("long").alias("part"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, piece = None, None, 0
        for batch in with_end(batches):
            now = held if batch is None else batch if held is None else pa.concat_batches([held, batch])
            if now is None or not now.num_rows:
                continue
            keys = list(zip(now.column(0).to_pylist(), now.column(1).to_pylist(), strict=True))
            cuts = [0]
            for i in range(1, len(keys)):
                if keys[i] != keys[i - 1] or i - cuts[-1] >= PIECE:
                    cuts.append(i)
            done = len(keys) if batch is None else cuts[-1]  # the last run may go on in the next batch
            held = now.slice(done)
            if not done:
                continue
            bounds = np.array([*(c for c in cuts if c < done), done])
            body = now.slice(0, done)
            strings, spans = assemble(pa.concat_arrays([body.column(2)]), pa.concat_arrays([body.column(3)]), bounds)
            pieces = []
            for i in bounds[:-1]:
                piece = piece + 1 if keys[i] == last else 0
                last = keys[i]
                pieces.append(piece)
            heads = body.take(pa.array(bounds[:-1]))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([heads.column(0), heads.column(1), pa.array(pieces, pa.int32()), strings, pa.array(spans, kind)], names=["conv_id", "part", "piece", "formatted", "loss"])

    return placed.mapInArrow(run, "conv_id long, part long, piece int, formatted string, loss array<struct<start:int,end:int>>")


def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, unescaped."""
    at = 0
    while at < len(formatted):
        close = formatted.index(CLOSE, at + len(OPEN))
        stop = formatted.index(STOP, close + len(CLOSE))
        yield unescape(formatted[at + len(OPEN) : close]), unescape(formatted[close + len(CLOSE) : stop])
        at = stop + len(STOP)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted parts say, by conversation: turns, digests of them and of the text under the loss mask.

    Parts are read in many tasks. A digest needs a conversation's texts in order, so what was read of it
    passes one task, which only hashes, a part at a time.
    """
    names = ["conv_id", "part", "piece", "n_turns", "said", "loss", "loss_chars", "chars"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], 0
            for row, (conv, part, piece, text, loss) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                turns = [f"{role}\n{said}\n" for role, said in parse(text)]
                under = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                found.append((conv, part, piece, len(turns), "".join(turns).encode(), under.encode(), len(under), len(text)))
                size += len(text)
                if size > SLICE or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
                    found, size = [], 0

    read = formatted.select("conv_id", "part", "piece", "formatted", "loss").mapInArrow(parsed, "conv_id long, part long, piece int, n_turns long, said binary, loss binary, loss_chars long, chars long")
    dealt = read.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list = []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def closed(rows: list[list]) -> pa.RecordBatch:
            cols = list(zip(*[(c, n, t.hexdigest(), k, h.hexdigest(), f) for c, n, t, k, h, f in rows], strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            done = []
            convs, _, _, turns, said, loss, loss_chars, chars = (c.to_pylist() for c in batch.columns)
            for row, conv in enumerate(convs):
                if not open_ or open_[0] != conv:
                    if open_:
                        done.append(open_)
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                open_[1] += turns[row]
                open_[2].update(said[row])
                open_[3] += loss_chars[row]
                open_[4].update(loss[row])
                open_[5] += chars[row]
            yield closed(done)
        if open_:
            yield closed([open_])

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(turns.unionByName(more)))


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_ORDER = "order by turn nulls first, role, text"
OP7_SQL = f"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' {_ORDER}) filter (where role = 'assistant'), '')) as loss_sha256,
  sum({len(OPEN) + len(CLOSE) + len(STOP)} + length({_escaped_sql('role')}) + length({_escaped_sql('text')}))::bigint as formatted_chars
from said group by conv_id
"""
