"""Chat formatting by columnar byte assembly.

Rows are formatted a batch at a time on byte arrays: control strings are found and
escaped, the lengths of headers, contents and ends give cumulative offsets, and headers and contents are scattered
to their places in one preallocated buffer, which becomes the Arrow column. Conversations are dealt by range, so a
very long one is formatted by several tasks.

A turn is ``### role: text </turn>\\n``. In texts and roles a backslash, ``###`` and ``</turn>`` get a backslash in
front, and in roles ``: `` too, which makes a turn's marks unmistakable and the text recoverable.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.tables import batches_of
from ledgersift.llm.words import slices, text_buffer

HEAD, MIDDLE, END = b"### ", b": ", b" </turn>\n"
_TURN = b"</turn>"
_ESCAPED = re.compile(rb"\\(\\|###|</turn>|: )")
_ROLE_END = re.compile(rb"\\(?:\\|###|</turn>|: )|: ")
ASSISTANT = "assistant"


def _escape_marks(body: np.ndarray, row: np.ndarray, colon: bool) -> np.ndarray:
    """Where a backslash goes in front of a byte."""
    n = len(body)
    marks = body == 92
    hashes = body == 35
    if hashes.any():
        start = hashes & np.concatenate(([True], ~hashes[:-1] | (row[1:] != row[:-1])))
        first = np.flatnonzero(start)
        run = np.cumsum(start) - 1
        at = np.flatnonzero(hashes)
        offset = at - first[run[at]]
        length = np.bincount(run[at], minlength=len(first))[run[at]]
        marks[at[(offset % 3 == 0) & (offset + 3 <= length)]] = True
    for word in (_TURN, MIDDLE) if colon else (_TURN,):
        if n >= len(word):
            hit = row[: n - len(word) + 1] == row[len(word) - 1:]
            for k, byte in enumerate(word):
                hit &= body[k: n - len(word) + 1 + k] == byte
            marks[np.flatnonzero(hit)] = True
    return marks


def _escaped(column: pa.Array, colon: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a column with its control strings escaped."""
    body, offsets = text_buffer(column)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    marks = _escape_marks(body, row, colon)
    extra = np.concatenate(([0], np.cumsum(marks)))
    out = np.full(len(body) + int(extra[-1]), 92, dtype=np.uint8)
    out[np.arange(len(body)) + extra[1:]] = body
    return out, offsets + extra[offsets]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted turns, and for each where its (escaped) text starts and ends in it, in bytes."""
    role_bytes, role_at = _escaped(roles, True)
    text_bytes, text_at = _escaped(texts, False)
    n = len(roles)
    role_n, text_n = np.diff(role_at), np.diff(text_at)
    lengths = len(HEAD) + role_n + len(MIDDLE) + text_n + len(END)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    buffer = np.empty(int(offsets[-1]), dtype=np.uint8)
    role_to = offsets[:-1] + len(HEAD)
    text_to = role_to + role_n + len(MIDDLE)
    for word, to in ((HEAD, offsets[:-1]), (MIDDLE, role_to + role_n), (END, text_to + text_n)):
        for k, byte in enumerate(word):
            buffer[to + k] = byte
    for source, at, size, to in ((role_bytes, role_at, role_n, role_to), (text_bytes, text_at, text_n, text_to)):
        buffer[np.arange(len(source)) - np.repeat(at[:-1], size) + np.repeat(to, size)] = source
    column = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)),
                                                          pa.py_buffer(buffer)])
    return column.cast(pa.binary()).cast(pa.string()), text_to - offsets[:-1], text_to + text_n - offsets[:-1]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            turns, start, end = assemble(part.column("role"), part.column("text"))
            yield batches_of(["conv_id", "turn", "role", "formatted", "text_start", "text_end", "loss"],
                             [part.column("conv_id"), part.column("turn"), part.column("role"), turns, start.astype(np.int64), end.astype(np.int64),
                              pa.array([r == ASSISTANT for r in part.column("role").to_pylist()])])


ORDER = ["conv_id", "turn", "role", "formatted"]


def formatted(rows: DataFrame) -> DataFrame:
    """One row per turn of ``rows`` (conv_id, turn, role, text): ``formatted``, and the bytes
    text_start to text_end of it that hold the text, under the loss mask where ``loss``.

    A conversation's formatted text is its turns' one after another, by turn (null first), role
    and formatted text. Null roles
    and texts are empty ones. Rows with a null conv_id are one conversation. Repeated rows are repeated turns.
    """
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = turns.repartitionByRange("conv_id", "turn", "role", F.xxhash64("text"))
    return dealt.mapInArrow(_format, "conv_id long, turn long, role string, formatted string, text_start long, "
                                     "text_end long, loss boolean")


def read_turn(turn: bytes) -> tuple[bytes, bytes]:
    """Role and text of a formatted turn."""
    if not (turn.startswith(HEAD) and turn.endswith(END)):
        raise ValueError("not a turn")
    at = len(HEAD)
    while True:
        found = _ROLE_END.search(turn, at)
        if not found:
            raise ValueError("not a turn")
        if found.group() == MIDDLE:
            break
        at = found.end()
    return (_ESCAPED.sub(rb"\1", turn[len(HEAD):found.start()]),
            _ESCAPED.sub(rb"\1", turn[found.end():len(turn) - len(END)]))


def _chars(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))


class _Digest:
    """Running digests of one conversation."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.n, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, turn: bytes, start: int, end: int, loss: bool) -> None:
        role, text = read_turn(turn)
        self.n += 1
        self.chars += _chars(turn)
        self.turns.update(role + b"\n" + text + b"\n")
        if loss:
            masked = _ESCAPED.sub(rb"\1", turn[start:end])
            self.loss.update(masked)
            self.loss_chars += _chars(masked)

    def row(self) -> tuple:
        return (self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        done = []
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "text_start", "text_end", "loss")]
        for k, (conv_id, start, end, loss) in enumerate(zip(*columns, strict=True)):
            if held is None or held.conv_id != conv_id:
                if held:
                    done.append(held.row())
                held = _Digest(conv_id)
            held.add(batch.column("formatted")[k].as_buffer().to_pybytes(), start, end, loss)
        yield batches_of(_NAMES, [pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 6, _TYPES,
                                                                 strict=True)])
    if held:
        yield batches_of(_NAMES, [pa.array([v], t) for v, t in zip(held.row(), _TYPES, strict=True)])


def read_back(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted turns: counts and digests.

    A digest of a conversation runs over it in order, so one task streams it; it holds one batch at a time.
    """
    return (turns.repartition("conv_id").sortWithinPartitions(*ORDER)
            .mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                    "loss_sha256 string, formatted_chars long"))
