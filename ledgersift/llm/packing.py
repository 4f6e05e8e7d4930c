"""Token ids packed into fixed-length rows, best fit decreasing.

Texts become token ids, each document ended by the end id. A document longer than a row is split into full rows and
a rest, losslessly. Segments gathered in a task are packed longest first, each into the open row with the least
room that still holds it; a segment tree over the capacities finds that row in logarithmic time. A task packs
``window`` tokens at a time, so memory is bounded, no document is shuffled and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.tables import batches_of, only
from ledgersift.llm.words import slices

LENGTH = 2_048
WINDOW = 4_000_000  # tokens packed together
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50_256
# Fixed value: how this vocabulary cuts a text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHED = 400_000
_TWO_SPACES = re.compile(r" \s* ")


class Encoder:
    """Token ids of a text as 16-bit little-endian bytes.

    A cut of the pattern never spans a space inside it except within a run of white space, so a text without two
    spaces in one such run may be encoded word by word, and words repeat: their ids are kept.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u2").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text or _TWO_SPACES.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        known = self.known
        new = set(rest).difference(known)
        if new:
            if len(known) + len(new) > _CACHED:
                known.clear()
                new = set(rest)
            encode = self.encoding.encode_ordinary
            for word in new:
                known[word] = np.array(encode(" " + word), dtype="<u2").tobytes()
        return (self.whole(first) if first else b"") + b"".join([known[word] for word in rest])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's one encoder for a vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Capacities:
    """Open rows by the room they have left; a segment tree over 0..most tells which rooms are there."""

    def __init__(self, most: int) -> None:
        self.width = 1 << most.bit_length()
        self.there = bytearray(2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.width + room
        while node and not self.there[node]:
            self.there[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes a row with the least room of at least ``need``: (room, row)."""
        node, there = self.width + need, self.there
        while not there[node]:
            while node & 1:  # a right child: go up
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            if node & (node - 1) == 0:  # ran off the right end of a level
                return None
        while node < self.width:
            node = 2 * node + (not there[2 * node])
        room = node - self.width
        row = self.rows[room].pop()
        if not self.rows[room]:
            while node and not (node < self.width and (there[2 * node] or there[2 * node + 1])):
                there[node] = 0
                node >>= 1
        return room, row


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of segment indices; every segment is at most ``length`` long."""
    tree, rows = Capacities(length), []
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        found = tree.take(size)
        room, row = found if found else (length, len(rows))
        if not found:
            rows.append([])
        rows[row].append(k)
        if room > size:
            tree.add(room - size, row)
    return rows


_NAMES = ["pack_id", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "starts"]


def _pack(path: str, length: int, window: int, end: int):
    def packed(docs: list, blobs: list[bytes], first: int) -> pa.RecordBatch:
        owner, begin, size, at = [], [], [], 0
        for k, blob in enumerate(blobs):
            n = len(blob) // 2
            for start in range(0, n, length):
                owner.append(k)
                begin.append(start)
                size.append(min(length, n - start))
        bounds = np.concatenate(([0], np.cumsum([len(b) // 2 for b in blobs])))
        flat = np.frombuffer(b"".join(blobs), dtype="<u2")
        rows = best_fit_decreasing(np.array(size, dtype=np.int64), length)
        out: dict[str, list] = {name: [] for name in _NAMES}
        for at, row in enumerate(rows):
            ids = np.full(length, end, dtype="<u2")
            positions = np.zeros(length, dtype="<u2")
            edges = np.concatenate(([0], np.cumsum([size[k] for k in row])))
            for k, a, b in zip(row, edges[:-1], edges[1:], strict=True):
                start = bounds[owner[k]] + begin[k]
                ids[a:b] = flat[start:start + size[k]]
                positions[a:b] = np.arange(size[k])
            out["pack_id"].append(first + at)
            out["n_tokens"].append(int(edges[-1]))
            out["ids"].append(ids.tobytes())
            out["positions"].append(positions.tobytes())
            out["cu_seqlens"].append(edges.astype(np.int32))
            out["doc_ids"].append([docs[owner[k]] for k in row])
            out["starts"].append([begin[k] for k in row])
        types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()),
                 pa.list_(pa.int64())]
        return batches_of(_NAMES, [pa.array(out[n], t) for n, t in zip(_NAMES, types, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stop = encoder(path), np.array([end], dtype="<u2").tobytes()
        next_id = TaskContext.get().partitionId() << 40
        docs, blobs, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                for doc, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    docs.append(doc)
                    blobs.append(encode(text or "") + stop)
                    held += len(blobs[-1]) // 2
                    if held >= window:
                        done = packed(docs, blobs, next_id)
                        next_id += done.num_rows
                        docs, blobs, held = [], [], 0
                        yield from (done.slice(k, 512) for k in range(0, done.num_rows, 512))
        if docs:
            done = packed(docs, blobs, next_id)
            yield from (done.slice(k, 512) for k in range(0, done.num_rows, 512))
    return run


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
           length: int = LENGTH, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per packed row of ``length`` ids.

    ids: ``length`` 16-bit little-endian ids, filled up with the end id; positions: as many 16-bit numbers that start
    again at each segment; cu_seqlens: the segments' borders; doc_ids and starts: for each segment its document and
    its first token's place in it. A null or empty text is the end id alone. Repeated rows are packed as often as
    they come. A document with a null id keeps a null in doc_ids. ``pack_id`` is unique; partition and order of the
    input decide it.
    """
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(_pack(vocabulary, length, window, end),
                           "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, "
                           "doc_ids array<long>, starts array<long>")
