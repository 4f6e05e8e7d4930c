"""Line dedup: lines that many documents share stay in one of them only.

Each document's lines become keys (stripped, A-Z lower-cased, digested to 128 bits). Distinct documents are counted
for each key; a document then gets the keys it must lose, and its text is put together again from the other lines,
in their order. Texts are shuffled once, to meet their document's keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.tables import batches_of, stored
from ledgersift.llm.words import LOWER, NOT_SPACE, slices, text_buffer

LEAST_CHARS = 20
LEAST_DOCS = 3


def line_keys(column: pa.Array) -> tuple[np.ndarray, ...]:
    """For all lines in order: row, start and end in the bytes, start and end of the key, and the key's code points."""
    body, offsets = text_buffer(column)
    breaks = np.flatnonzero(body == 10)
    row_breaks = np.diff(np.searchsorted(breaks, offsets))
    row = np.repeat(np.arange(len(offsets) - 1), row_breaks + 1)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((breaks, offsets[1:])))
    solid = np.flatnonzero(NOT_SPACE[body])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = high > low
    first, last = starts.copy(), starts.copy()
    first[some], last[some] = solid[low[some]], solid[high[some] - 1] + 1
    heads = np.flatnonzero((body & 0xC0) != 0x80)  # first bytes of code points
    points = np.searchsorted(heads, last) - np.searchsorted(heads, first)
    return row, starts, ends, first, last, points


def digests(column: pa.Array, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """BLAKE2 digests (128 bits, as two longs) of stretches of the column's bytes, A-Z lower-cased."""
    small = LOWER[text_buffer(column)[0]]
    found = [hashlib.blake2b(small[a:b], digest_size=16).digest()
             for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)


def _keys(least_chars: int):
    """The distinct keys of each document that are long enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text = part.column("text")
                row, _, _, first, last, points = line_keys(text)
                use = points >= least_chars
                keys = digests(text, first[use], last[use])
                every = np.unique(np.column_stack((row[use], keys)), axis=0)
                yield batches_of(["doc_id", "k1", "k2"], [part.column("doc_id").take(pa.array(every[:, 0])),
                                                          every[:, 1].copy(), every[:, 2].copy()])
    return run


def _rebuild(least_chars: int):
    """Texts without the lines whose keys their document loses."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, lost = part.column("text"), part.column("lost")
                body, _ = text_buffer(text)
                row, starts, ends, first, last, points = line_keys(text)
                n_lost = np.nan_to_num(lost.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                owner, flat = np.repeat(np.arange(len(lost)), n_lost), lost.flatten()
                drop = np.zeros(len(row), dtype=bool)
                if len(owner):
                    maybe = np.flatnonzero((points >= least_chars) & (n_lost > 0)[row])
                    dead = np.column_stack((owner, *(flat.field(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2"))))
                    have = np.column_stack((row[maybe], digests(text, first[maybe], last[maybe])))
                    drop[maybe] = np.isin(_as_one(have), _as_one(dead))
                n_lines = np.bincount(row, minlength=len(lost))
                n_dropped = np.bincount(row[drop], minlength=len(lost))
                begin = np.concatenate(([0], np.cumsum(n_lines)))
                texts = []
                for k in range(len(lost)):
                    a, b = begin[k], begin[k + 1]
                    if not n_dropped[k]:
                        texts.append(body[starts[a]:ends[b - 1]].tobytes())
                    else:
                        texts.append(b"\n".join(body[starts[j]:ends[j]].tobytes()
                                                for j in range(a, b) if not drop[j]))
                yield batches_of(["doc_id", "n_lines", "n_dropped", "text"],
                                 [part.column("doc_id"), n_lines.astype(np.int64), n_dropped.astype(np.int64),
                                  pa.array(texts, pa.binary()).cast(pa.string())])
    return run


def _as_one(keys: np.ndarray) -> np.ndarray:
    """Rows of three longs as one value each, all 24 bytes of it."""
    return np.ascontiguousarray(keys.astype("<i8")).view("V24").ravel()


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, text (of the lines that stay).

    Lines end at \\n. A key of at least ``least_chars`` code points in at least ``least_docs`` different documents
    loses all its lines except in the largest doc_id holding it. A null or empty text is one empty line. Rows that
    share a doc_id count as one document and are treated alike; a row without doc_id counts for no key and loses
    nothing. A document that loses all lines has an empty text. Other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    keys = stored(rows.where("doc_id IS NOT NULL").mapInArrow(_keys(least_chars), "doc_id long, k1 long, k2 long"),
                  "lines")
    shared = (keys.groupBy("k1", "k2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
              .where(F.col("n_docs") >= least_docs).select("k1", "k2", "keeper"))
    lost = (keys.join(shared, ["k1", "k2"]).where("doc_id != keeper")
            .groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("lost")))
    met = rows.join(lost, "doc_id", "left").withColumn(
        "lost", F.coalesce("lost", F.expr("array()").cast("array<struct<k1: bigint, k2: bigint>>")))
    return met.mapInArrow(_rebuild(least_chars), "doc_id long, n_lines long, n_dropped long, text string")
