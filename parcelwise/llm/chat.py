"""Chat formatting by columnar byte assembly.

A turn becomes `### Role:` and a line break, its text and `</turn>` and a line break.
Inside roles and texts a backslash goes before every `#`, before the `/` of `</` and
before every backslash, and a line break in a role becomes `\\n`, so no control string
occurs in contents and the output can be read back exactly. For a block of turns,
segment lengths give cumulative offsets, and header, content and closing bytes are
scattered into one preallocated buffer, which backs the Arrow column.

Rows are ordered by turn, then role and text (nulls first); rows with a null conv_id
form one conversation. Null roles and texts count as empty; repeated rows are turns of
their own; other columns are ignored; an empty table gives nothing. A conversation's
turns go through one task as a stream, in sorted blocks, and are never held together.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import row_blocks, small_batches, text_buffers

# The template.
OPEN, NAMED, CLOSE = b"### ", b":\n", b"</turn>\n"
TRAINED = "assistant"
FORMATTED = "conv_id long, turn long, formatted string, loss_start long, loss_end long"
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
TURN = re.compile(r"### ((?:[^\\\n]|\\.)*):\n(.*?)</turn>\n", re.S)


def escaped(column: pa.Array, line: bool) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, bytes) of the texts with control bytes escaped; line: line breaks too."""
    offs, raw = text_buffers(column)
    marks = (raw == 0x5C) | (raw == 0x23)
    marks[1:] |= (raw[1:] == 0x2F) & (raw[:-1] == 0x3C)
    if (starts := offs[:-1][offs[:-1] < len(raw)]).size:  # a text's first byte follows nothing
        first = starts[raw[starts] == 0x2F]
        marks[first] = False
    if line:
        marks |= raw == 0x0A
    moved = np.concatenate([[0], np.cumsum(marks)])
    out = np.full(len(raw) + int(moved[-1]), 0x5C, np.uint8)
    put = np.where(raw == 0x0A, np.uint8(0x6E), raw) if line else raw
    out[np.arange(len(raw)) + moved[1:]] = put
    return np.diff(offs) + np.diff(moved[offs]), out


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The turns' formatted segments over one buffer, and where each one's text starts and ends in it, in code points."""
    (role_n, role), (text_n, text) = escaped(roles, True), escaped(texts, False)
    fixed = [np.frombuffer(x, np.uint8) for x in (OPEN, NAMED, CLOSE)]
    n = len(texts)
    parts = np.stack([np.full(n, len(OPEN)), role_n, np.full(n, len(NAMED)), text_n, np.full(n, len(CLOSE))], 1)
    at = np.concatenate([[0], np.cumsum(parts.ravel())])
    begin = at[:-1].reshape(n, 5)
    out = np.empty(int(at[-1]), np.uint8)
    for k, body in ((0, fixed[0]), (2, fixed[1]), (4, fixed[2])):
        out[begin[:, k, None] + np.arange(len(body))] = body
    for k, sizes, body in ((1, role_n, role), (3, text_n, text)):
        shift = begin[:, k] - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if n else np.zeros(0, np.int64)
        out[np.arange(len(body)) + np.repeat(shift, sizes)] = body
    ends = np.append(begin[:, 0], at[-1]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out)])
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    base = points[begin[:, 0]]
    return column, points[begin[:, 3]] - base, points[begin[:, 4]] - base


def _formatted(batches):
    names = [x.split()[0] for x in FORMATTED.split(", ")]
    conv, turn, done = object(), 0, 0
    for batch in batches:
        for lo, hi in row_blocks(batch.column(3)):
            ids, _, roles, texts = (c.slice(lo, hi - lo) for c in batch.columns)
            column, start, end = assemble(roles, texts)
            sizes = pc.utf8_length(column).to_numpy()
            trained = pc.equal(pc.fill_null(roles, ""), TRAINED).to_numpy(zero_copy_only=False)
            turns, offsets = [], []
            for c, n in zip(ids.to_pylist(), sizes.tolist(), strict=True):
                if c != conv:
                    conv, turn, done = c, 0, 0
                turns.append(turn)
                offsets.append(done)
                turn, done = turn + 1, done + n
            offsets = np.array(offsets, np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(turns, pa.int64()), column.cast(pa.string()), pa.array(start + offsets, mask=~trained), pa.array(end + offsets, mask=~trained)], names=names)


def format_chats(rows: DataFrame) -> DataFrame:
    """One row for each turn, in order: its part of the conversation's formatted output and the loss mask's span.

    `turn` counts from 0; loss_start and loss_end are code points of the conversation's
    whole output (its parts joined), null where nothing is trained on.
    """
    own = small_batches(rows).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_formatted, FORMATTED)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


class Reader:
    """Reads a conversation's output back, part by part, into running digests."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.n, self.trained, self.size = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, part: str, loss: tuple[int, int] | None) -> None:
        for m in TURN.finditer(part):
            self.turns.update(f"{unescaped(m[1])}\n{unescaped(m[2])}\n".encode())
            self.n += 1
        if loss:
            text = unescaped(part[loss[0] - self.size : loss[1] - self.size])
            self.loss.update(text.encode())
            self.trained += len(text)
        self.size += len(part)

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.trained, self.loss.hexdigest(), self.size


def _read_back(batches):
    names = [x.split()[0] for x in READ_BACK.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
    now, rows = None, []
    for batch in batches:
        for conv, turn, part, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if turn == 0:
                if now:
                    rows.append(now.row())
                now = Reader(conv)
            now.add(part, None if a is None else (a, b))
        if rows:
            yield as_batch(rows)
            rows = []
    yield as_batch([now.row()] if now else [])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted output holds, one row for each conversation; `formatted` as format_chats gives it."""
    return formatted.mapInArrow(_read_back, READ_BACK)
