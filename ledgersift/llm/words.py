"""Words of whole texts as 64-bit hashes, worked out on the bytes of Arrow string columns.

A text is never turned into Python strings: word borders, lower case and hashes come from array operations
over the column's bytes, in pieces of bounded size. A word's hash is a chain over its 8-byte blocks, each mixed into what
came before; words of more than a few blocks take the first 64 bits of a BLAKE2 digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 2 << 20  # bytes worked on at once
U64 = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z count as a-z
#: Blocks of 8 bytes that are chained; longer words are digested.
CHAINED = 4

#: Bytes of words: anything but ASCII white space, and ASCII letters and digits with all non-ASCII bytes.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spreads 64-bit values over all bits (the public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0]:offsets[-1]] if len(offsets) else body, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes; a longer text stands alone."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def _cuts(body: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of the bytes that end at row borders or between words."""
    start, end = 0, len(body)
    while end - start > 2 * PIECE:
        stop = start + PIECE
        while stop < end and inside[body[stop]]:
            stop += 1
        yield start, stop
        start = stop
    yield start, end


def word_spans(body: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a row border ends a word."""
    flags = inside[body]
    edge = np.zeros(len(body) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], flags[:-1])) if len(flags) else flags
    after = np.concatenate((flags[1:], [False])) if len(flags) else flags
    starts = np.flatnonzero(flags & (~before | edge[:-1]))
    ends = np.flatnonzero(flags & (~after | edge[1:])) + 1
    return starts, ends


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes, A-Z taken as a-z."""
    small = np.concatenate((LOWER[body], np.zeros(8, np.uint8)))
    at_any_byte = np.ndarray((len(body) + 1,), "<u8", buffer=small, strides=(1,))
    lengths = ends - starts
    hashes = mix(lengths.astype(U64), 1)
    with np.errstate(over="ignore"):
        for k in range(CHAINED):
            more = np.flatnonzero((lengths > 8 * k) & (lengths <= 8 * CHAINED))
            if not len(more):
                break
            left = np.minimum(lengths[more] - 8 * k, 8)
            block = at_any_byte[starts[more] + 8 * k] & (U64(2**64 - 1) >> (64 - 8 * left).astype(U64))
            hashes[more] = mix(hashes[more] ^ mix(block, 2), 3 + k)
    long = np.flatnonzero(lengths > 8 * CHAINED)
    if len(long):
        digests = [hashlib.blake2b(small[a:b], digest_size=8).digest()
                   for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        hashes[long] = np.frombuffer(b"".join(digests), U64)
    return hashes


def _hashed(column: pa.Array, inside: np.ndarray, prefixes: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each prefix (0: the whole word) the hashes of all words, and the index of each row's first word."""
    body, offsets = text_buffer(column)
    found, first = [[np.zeros(0, U64)] for _ in prefixes], [np.zeros(0, np.int64)]
    for a, b in _cuts(body, offsets, inside):
        part = body[a:b]
        borders = offsets[(offsets >= a) & (offsets <= b)] - a
        starts, ends = word_spans(part, borders, inside)
        first.append(starts + a)
        if len(starts):
            for out, prefix in zip(found, prefixes, strict=True):
                out.append(span_hashes(part, starts, np.minimum(ends, starts + prefix) if prefix else ends))
    return [np.concatenate(out) for out in found], np.searchsorted(np.concatenate(first), offsets)


def words(column: pa.Array, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row the index of its first word (one more at the end)."""
    (hashes,), first = _hashed(column, inside, (0,))
    return hashes, first


def words_and_beginnings(column: pa.Array, inside: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``words``, with the hashes of the words' first ``prefix`` bytes in second place."""
    (hashes, beginnings), first = _hashed(column, inside, (0, prefix))
    return hashes, beginnings, first


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words by its first word, over the whole array (rows not told apart)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    value = hashes[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, size):
            value = mix(value, k) + hashes[k:k + n]
    return mix(value, size)
