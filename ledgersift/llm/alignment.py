"""Alignment of two tokenizers' tokens over the bytes of each document.

Tokens are described by the byte they end at. Where a token of both tokenizers ends at the same byte the text is cut
into groups. What is known of a byte range is a ``Fragment``: an open prefix up to its first cut, closed groups, and an
open suffix behind its last cut. Fragments of neighbouring ranges compose, and it does not matter in which order,
so the pieces of a very long document are worked on by different tasks and put together by a tree of groupings.

Pieces are cut before a single space between two other characters. Neither tokenizer joins a character that is no space to a
space behind it, so both start afresh there and the pieces' tokens are those of the whole text.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.tables import only, stored

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

#: Characters of a piece of a long text; texts up to this length are worked on whole.
PIECE_CHARS = 32_768
#: Fragments that one task composes at once.
FAN = 8
#: Words that a worker keeps at least when it forgets those not in use, and characters of text it learns from at once.
WORDS = 150_000
LEARN_CHARS = 1 << 19
#: Rows whose texts are Python strings at a time.
ROWS = 256
#: A pair found in more than 1 / HOT_SHARE of all (document, pair) rows is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1 << 18
#: (pair, count) entries that a task sums up before it hands them on.
HELD_PAIRS = 1 << 21
#: Id pairs of documents that a task works on at once, whatever the size of the batch they came in.
STRETCH_PAIRS = 1 << 18

_BREAK = re.compile(r"(?<=\S) (?=\S)")
_NOT_ALONE = re.compile(r"^\s|\s\s|\s\Z")
_I64 = np.int64


@dataclass(frozen=True)
class Tokens:
    """Ids of consecutive tokens and the byte each ends at, counted from the start of the document."""

    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0, _I64))

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(np.concatenate((self.ids, other.ids)), np.concatenate((self.ends, other.ends)))

    def __getitem__(self, part: slice) -> Tokens:
        return Tokens(self.ids[part], self.ends[part])


NO_TOKENS = Tokens()


@dataclass(frozen=True)
class Fragment:
    """What the tokens ending in a byte range say about a document's groups.

    ``prefix`` holds (A, B) tokens up to the first cut, ``suffix`` those behind the last; without a cut all tokens are
    prefix. ``closed`` is the text of the groups between, ``pairs`` and ``times`` their links by id pair, ``n_a`` and ``n_b``
    count all tokens of the range.
    """

    prefix: tuple[Tokens, Tokens] = (NO_TOKENS, NO_TOKENS)
    suffix: tuple[Tokens, Tokens] = (NO_TOKENS, NO_TOKENS)
    cut: bool = False
    closed: bytes = b""
    n_groups: int = 0
    n_a: int = 0
    n_b: int = 0
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, _I64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, _I64))


EMPTY = Fragment()


def fragment(a: Tokens, b: Tokens) -> Fragment:
    """The fragment of the tokens that end in one byte range."""
    common = np.intersect1d(a.ends, b.ends, assume_unique=True)
    if not len(common):
        return Fragment(prefix=(a, b), n_a=len(a.ids), n_b=len(b.ids))
    sides, middle = [], []
    for side in (a, b):
        first, last = np.searchsorted(side.ends, common[[0, -1]], side="right")
        sides.append((side[:first], side[last:]))
        middle.append(side[first:last])
    text, pairs, times = close(middle[0], middle[1])
    return Fragment((sides[0][0], sides[1][0]), (sides[0][1], sides[1][1]), True, text, len(common) - 1,
                    len(a.ids), len(b.ids), pairs, times)


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges; associative, with ``EMPTY`` as its neutral element."""
    n_a, n_b = left.n_a + right.n_a, left.n_b + right.n_b
    if not left.cut:
        prefix = tuple(x + y for x, y in zip(left.prefix, right.prefix, strict=True))
        return Fragment(prefix, right.suffix, right.cut, right.closed, right.n_groups, n_a, n_b, right.pairs, right.times)
    open_ = tuple(x + y for x, y in zip(left.suffix, right.prefix, strict=True))
    if not right.cut:
        return Fragment(left.prefix, open_, True, left.closed, left.n_groups, n_a, n_b, left.pairs, left.times)
    text, pairs, times = close(*open_)
    return Fragment(left.prefix, right.suffix, True, _joined(left.closed, text, right.closed),
                    left.n_groups + right.n_groups + 1, n_a, n_b,
                    *summed(np.concatenate((left.pairs, pairs, right.pairs)),
                            np.concatenate((left.times, times, right.times))))


def whole(one: Fragment) -> Fragment:
    """A whole document's fragment with its prefix closed: the first group begins with the document."""
    if not one.cut:
        return one
    text, pairs, times = close(*one.prefix)
    return Fragment(cut=True, closed=_joined(text, one.closed), n_groups=one.n_groups + 1, n_a=one.n_a, n_b=one.n_b,
                    **dict(zip(("pairs", "times"), summed(np.concatenate((pairs, one.pairs)),
                                                          np.concatenate((times, one.times))), strict=True)))


def close(a: Tokens, b: Tokens) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Text and links of whole groups: tokens that start at a cut and end at one."""
    if not len(a.ids):
        return b"", np.zeros(0, _I64), np.zeros(0, _I64)
    return _text(a, b), *summed(links(a, b))


def _either(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The values of two ascending arrays, each once, ascending; a stable sort merges two runs."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both


def links(a: Tokens, b: Tokens) -> np.ndarray:
    """The id pair of each pair of overlapping tokens: between two ends lie one token of A and one of B."""
    ends = _either(a.ends, b.ends)
    return (a.ids[np.searchsorted(a.ends, ends)].astype(_I64) << 32) | b.ids[np.searchsorted(b.ends, ends)]


def summed(pairs: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, ascending, with its number of occurrences."""
    if times is None:
        return tuple(x.astype(_I64) for x in np.unique(pairs, return_counts=True))
    found, at = np.unique(pairs, return_inverse=True)
    return found, np.bincount(at, weights=times, minlength=len(found)).astype(_I64)


def _joined(*texts: bytes) -> bytes:
    return b";".join(t for t in texts if t)


def _text(a: Tokens, b: Tokens) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: decimal ids, put together on bytes."""
    return _texts(a, b, a.ends[-1:])[0]


def _texts(a: Tokens, b: Tokens, borders: np.ndarray) -> list[bytes]:
    """The text of the groups up to each border, from the border before it; borders are cuts."""
    common = np.intersect1d(a.ends, b.ends, assume_unique=True)
    of_a, of_b = np.searchsorted(common, a.ends), np.searchsorted(common, b.ends)
    group = np.concatenate((of_a, of_b))
    order = np.argsort(2 * group + (np.arange(len(group)) >= len(of_a)), kind="stable")
    ids = np.concatenate((a.ids, b.ids)).astype(_I64)[order]
    side, group = order >= len(of_a), group[order]
    last = np.concatenate((side[1:] != side[:-1], [True])) | np.concatenate((group[1:] != group[:-1], [True]))
    separator = np.where(last, np.where(side, ord(";"), ord("|")), ord(",")).astype(np.uint8)
    written, lengths = _decimal(ids, separator)
    stops = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(group, np.searchsorted(common, borders), "right")]
    out, start = [], 0
    for stop in stops.tolist():
        out.append(written[start:stop - 1])
        start = stop
    return out


def _decimal(ids: np.ndarray, after: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All ids in decimal, each followed by its own byte, and how many bytes each takes."""
    width = len(str(int(ids.max())))
    out = np.zeros((len(ids), width + 1), np.uint8)
    shown = np.zeros(out.shape, bool)
    for k in range(width):
        power = 10 ** (width - 1 - k)
        out[:, k] = ids // power % 10 + 48
        shown[:, k] = (ids >= power) | (k == width - 1)
    out[:, -1], shown[:, -1] = after, True
    return out[shown].tobytes(), shown.sum(axis=1)


def words_of(text: str) -> list[str]:
    """The stretches of text between breaks."""
    return _BREAK.split(text) if _NOT_ALONE.search(text) else text.split(" ")


class Pair:
    """The two tokenizers of one Python worker, with what is known of words already met.

    A word is a stretch of text between breaks with the space before it, and begins and ends at a cut, so its groups
    and links are its own. Of each: A tokens, B tokens, groups (0: its tokens do not give it back), the text of its groups
    and the id pairs of its links, these as bytes.
    """

    def __init__(self, byte_vocabulary: str, piece_vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_vocabulary)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary)
        decoded = _byte_level()
        tokens = {i: bytes(decoded[c] for c in t) if all(c in decoded for c in t) else t.encode()
                  for t, i in self.a.get_vocab().items()}
        tokens |= {i: added.content.encode() for i, added in self.a.get_added_tokens_decoder().items()}
        self.bytes_a = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.bytes_b = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.length_a = np.array([len(t) for t in self.bytes_a], _I64)
        self.length_b = np.array([len(t) for t in self.bytes_b], _I64)
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        #: Documents of a batch: their number, A's ids and B's ids go into one 64-bit sort key.
        self.doc_bits = 32 + len(self.bytes_a).bit_length()
        self.most_docs = 1 << (63 - self.doc_bits)

    def encode(self, text: str) -> tuple[Tokens, Tokens] | None:
        """Both tokenizers' tokens of a space and the text; None where they do not give it back."""
        want = (" " + text).encode()
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        if b"".join([self.bytes_a[i] for i in a]) != want or b"".join([self.bytes_b[i] for i in b]) != want:
            return None
        a, b = np.array(a, np.int32), np.array(b, np.int32)
        return Tokens(a, np.cumsum(self.length_a[a])), Tokens(b, np.cumsum(self.length_b[b]))

    def learn(self, words: Iterable[str]) -> None:
        """Makes all these words known. New ones are encoded as one text; words in use stay, others are forgotten in time."""
        if len(self.known) > WORDS:
            self.older, self.known = self.known, {}
        new, single = [], []
        for w in words:
            if w not in self.known:
                if w in self.older:
                    self.known[w] = self.older[w]
                else:
                    (single if w[0].isspace() or w[-1].isspace() else new).append(w)
        together = self.encode(" ".join(new)) if new else None
        if together:
            self._keep(new, *together)
        else:
            single += new
        for w in single:
            alone = self.encode(w)
            if alone:
                self._keep([w], *alone)
            else:
                self.known[w] = (0, 0, 0, b"", b"")

    def _keep(self, words: list[str], a: Tokens, b: Tokens) -> None:
        borders = np.cumsum([1 + len(w.encode()) for w in words])
        texts, pairs = _texts(a, b, borders), links(a, b)
        ends = np.searchsorted(_either(a.ends, b.ends), borders, "right").tolist()
        n_a, n_b, n_groups = (np.diff(np.searchsorted(x, borders, "right"), prepend=0).tolist()
                              for x in (a.ends, b.ends, np.intersect1d(a.ends, b.ends, assume_unique=True)))
        start = 0
        for w, text, stop, *n in zip(words, texts, ends, n_a, n_b, n_groups, strict=True):
            self.known[w] = (*n, text, pairs[start:stop].tobytes())
            start = stop

    def documents(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        """Whole documents, put together from their words: counts and digests, and each one's id pairs with their number
        of occurrences, from ``first`` of the document to that of the next. Without tokens all is 0 and ''.
        """
        split = [words_of(t) for t in texts]
        words = list(dict.fromkeys(itertools.chain.from_iterable(split)))
        self.learn(words)
        found = [self.known[w] for w in words]
        number = dict(zip(words, range(len(words)), strict=True))
        at = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(split)), _I64)
        counts = np.array([len(w) for w in split])
        first, doc = np.concatenate(([0], np.cumsum(counts)))[:-1], np.repeat(np.arange(len(split)), counts)
        numbers = np.array([w[:3] for w in found], _I64)
        use = np.logical_and.reduceat(numbers[at, 2] > 0, first)
        n_a, n_b, n_groups = np.where(use, np.add.reduceat(numbers[at], first).T, 0)
        written = [w[3] for w in found]
        ends = (first + counts).tolist()
        digests = [hashlib.sha256(b";".join([written[k] for k in at[low:high].tolist()])).hexdigest() if ok else ""
                   for low, high, ok in zip(first.tolist(), ends, use.tolist(), strict=True)]
        # Each word of a document once, then its pairs, as often as the word occurs.
        once, times = np.unique(doc[use[doc]] * len(words) + at[use[doc]], return_counts=True)
        doc, word = np.divmod(once, len(words))
        n_pairs = np.array([len(w[4]) // 8 for w in found])
        begin = np.cumsum(n_pairs) - n_pairs
        reps = n_pairs[word]
        place = np.repeat(begin[word] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        key = (np.repeat(doc, reps) << self.doc_bits) | np.frombuffer(b"".join([w[4] for w in found]), _I64)[place]
        order = np.argsort(key)
        key, times = key[order], np.repeat(times, reps)[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, _I64)
        times = np.add.reduceat(times, new) if len(key) else times
        doc, pairs = key[new] >> self.doc_bits, key[new] & ((1 << self.doc_bits) - 1)
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "digests": digests, "pairs": pairs, "times": times,
                "first": np.searchsorted(doc, np.arange(len(split) + 1))}

    def piece(self, text: str, start: int) -> tuple[Fragment, bool]:
        """The fragment of a piece of a document whose space is at byte ``start``, and whether its tokens give it back."""
        found = self.encode(text)
        if found is None:
            return EMPTY, False
        return fragment(*[Tokens(t.ids, t.ends + start) for t in found]), True


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for
    themselves, the other bytes, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(paths: tuple[str, str]) -> Pair:
    """The worker's own tokenizers, loaded once."""
    if paths not in _PAIRS:
        _PAIRS[paths] = Pair(*paths)
    return _PAIRS[paths]


def pieces(text: str, size: int) -> Iterator[tuple[int, str]]:
    """(byte place of its space, piece) of a text cut at the first break behind each ``size`` characters.

    The space before the text is at byte 0. A text without breaks stays whole.
    """
    start = at = 0
    while start < len(text):
        found = _BREAK.search(text, start + size)
        stop = found.start() if found else len(text)
        yield at, text[start:stop]
        at += 1 + len(text[start:stop].encode())
        start = stop + 1


_OPEN = [f"{side}_{end}_{what}" for end in ("prefix", "suffix") for side in "ab" for what in ("ids", "ends")]
_FRAGMENT = pa.schema([("at", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("faithful", pa.bool_()),
                       ("cut", pa.bool_()), ("closed", pa.binary()),
                       *[(c, pa.int64()) for c in ("n_groups", "n_a", "n_b")],
                       *[(c, pa.list_(pa.int64())) for c in ("pairs", "times", *_OPEN)]])
_FRAGMENT_DDL = ("at long, doc_id long, part long, faithful boolean, cut boolean, closed binary, n_groups long, n_a long, "
                 "n_b long, " + ", ".join(f"{c} array<long>" for c in ("pairs", "times", *_OPEN)))
_DOCUMENT = pa.schema([("at", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("place", pa.int64()),
                       ("piece", pa.string()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                       ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())),
                       ("times", pa.list_(pa.int64()))])
_DOCUMENT_DDL = ("at long, doc_id long, part long, place long, piece string, n_a long, n_b long, n_groups long, "
                 "n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def _document_row(at: int, doc_id: int | None, one: Fragment | None) -> dict:
    """A finished document; without tokens all its numbers are 0 and its digest is ''."""
    row = {"at": at, "doc_id": doc_id, "part": None, "place": None, "piece": None}
    if one is None:
        return row | {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "pairs": [], "times": []}
    return row | {"n_a": one.n_a, "n_b": one.n_b, "n_groups": one.n_groups, "n_links": int(one.times.sum()),
                  "groups_sha256": hashlib.sha256(one.closed).hexdigest(), "pairs": one.pairs, "times": one.times}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def _batched(rows: Iterator[dict], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches whose lists and texts hold about ``weight`` entries."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row.values() if isinstance(v, str | bytes | np.ndarray))
        if size >= weight:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _lean(run: Callable) -> Callable:
    """The same work; what Arrow's pool keeps of freed batches goes back to the system instead of staying with the worker."""
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return lean


def _first_pass(paths: tuple[str, str], piece_chars: int) -> Callable:
    """Finishes documents of ordinary length and cuts the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                yield from zip(*(part.column(c).to_pylist() for c in ("at", "doc_id", "text")), strict=True)

        for batch in batches:
            short, chars, without = [], 0, []
            for at, doc_id, text in rows(batch):
                if not text:
                    without.append(_document_row(at, doc_id, None))
                elif len(text) > piece_chars:
                    cut = (dict.fromkeys(_DOCUMENT.names) | {"at": at, "doc_id": doc_id, "part": part, "place": place,
                                                             "piece": piece}
                           for part, (place, piece) in enumerate(pieces(text, piece_chars)))
                    yield from _batched(cut, _DOCUMENT, 1 << 20)
                else:
                    short.append((at, doc_id, text))
                    chars += len(text)
                    if chars >= LEARN_CHARS or len(short) == _pair(paths).most_docs:
                        yield _finished(short, paths)
                        short, chars = [], 0
            if short:
                yield _finished(short, paths)
            if without:
                yield _batch(without, _DOCUMENT)

    return run


def _finished(short: list[tuple], paths: tuple[str, str]) -> pa.RecordBatch:
    at, doc_ids, texts = zip(*short, strict=True)
    one = _pair(paths).documents(list(texts))
    first = pa.array(one["first"], pa.int32())
    nothing = {c: pa.nulls(len(short), _DOCUMENT.field(c).type) for c in ("part", "place", "piece")}
    total = np.concatenate(([0], np.cumsum(one["times"])))[one["first"]]
    columns = nothing | {"at": pa.array(at, pa.int64()), "doc_id": pa.array(doc_ids, pa.int64()),
                         "n_links": pa.array(np.diff(total)), "groups_sha256": pa.array(one["digests"], pa.string()),
                         **{c: pa.array(one[c]) for c in ("n_a", "n_b", "n_groups")},
                         **{c: pa.ListArray.from_arrays(first, pa.array(one[c])) for c in ("pairs", "times")}}
    return pa.RecordBatch.from_arrays([columns[c] for c in _DOCUMENT.names], schema=_DOCUMENT)


def _fragment_row(at: int, doc_id: int | None, part: int, one: Fragment, faithful: bool) -> dict:
    ends = dict(zip(_OPEN, [x for two in (one.prefix, one.suffix) for t in two for x in (t.ids, t.ends)], strict=True))
    return {"at": at, "doc_id": doc_id, "part": part, "faithful": faithful, "cut": one.cut, "closed": one.closed,
            "n_groups": one.n_groups, "n_a": one.n_a, "n_b": one.n_b, "pairs": one.pairs, "times": one.times} | ends


def _fragment_of(row: dict) -> Fragment:
    def tokens(side: str, end: str) -> Tokens:
        return Tokens(np.array(row[f"{side}_{end}_ids"], np.int32), np.array(row[f"{side}_{end}_ends"], _I64))

    return Fragment((tokens("a", "prefix"), tokens("b", "prefix")), (tokens("a", "suffix"), tokens("b", "suffix")),
                    row["cut"], row["closed"], row["n_groups"], row["n_a"], row["n_b"],
                    np.array(row["pairs"], _I64), np.array(row["times"], _I64))


def _encode_pieces(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield _fragment_row(r["at"], r["doc_id"], r["part"], *_pair(paths).piece(r["piece"], r["place"]))

        yield from _batched(rows(), _FRAGMENT, 1 << 20)

    return run


def _stretch(table: pa.Table) -> tuple[int, int | None, int, Fragment, bool]:
    """The fragments of one stretch of a document, in order, as one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    faithful = all(r["faithful"] for r in rows)
    one = reduce(compose, [_fragment_of(r) for r in rows], EMPTY) if faithful else EMPTY
    return rows[0]["at"], rows[0]["doc_id"], rows[0]["part"] // FAN, one, faithful


def _composed(table: pa.Table) -> pa.Table:
    """One stretch of a document as a fragment of the next level."""
    return pa.Table.from_batches([_batch([_fragment_row(*_stretch(table))], _FRAGMENT)])


def _composed_whole(table: pa.Table) -> pa.Table:
    """All that is left of a document, finished."""
    at, doc_id, _, one, faithful = _stretch(table)
    return pa.Table.from_batches([_batch([_document_row(at, doc_id, whole(one) if faithful else None)], _DOCUMENT)])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _document_row(r["at"], r["doc_id"], whole(_fragment_of(r)) if r["faithful"] else None)

    yield from _batched(rows(), _DOCUMENT, 1 << 20)


def _long_documents(parts: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Documents in pieces: each piece becomes a fragment, and levels of groupings compose them.

    The last level also finishes them: a step of its own behind it would keep a second Python worker in each task.
    """
    most = parts.agg(F.max("part")).first()[0]
    level = stored(parts.select("at", "doc_id", "part", "place", "piece").repartition("at", "part")
                   .mapInArrow(_lean(_encode_pieces(paths)), _FRAGMENT_DDL), "fragments")
    if not most:
        return level.mapInArrow(_finish, _DOCUMENT_DDL)
    left = most
    stretch = F.floor(F.col("part") / FAN).alias("stretch")
    while left >= FAN:
        level = level.groupBy("at", stretch).applyInArrow(_composed, _FRAGMENT_DDL)
        left //= FAN
    return level.groupBy("at", stretch).applyInArrow(_composed_whole, _DOCUMENT_DDL)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most ``STRETCH_PAIRS`` id pairs, or of one document."""
    for batch in batches:
        offsets = batch.column("pairs").offsets.to_numpy(zero_copy_only=False)
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + STRETCH_PAIRS, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's documents each pair is linked, in runs of bounded length."""
    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    def added() -> tuple[np.ndarray, np.ndarray]:
        new, times = summed(np.concatenate(fresh))
        return summed(np.concatenate((keys, new)), np.concatenate((n, times)))

    keys, n, fresh, waiting = np.zeros(0, _I64), np.zeros(0, _I64), [], 0
    for part in _stretches(batches):
        fresh.append(part.column("pairs").flatten().to_numpy(zero_copy_only=False))
        waiting += len(fresh[-1])
        if waiting >= max(STRETCH_PAIRS, len(keys)):
            keys, n = added()
            fresh, waiting = [], 0
            if len(keys) >= HELD_PAIRS:
                yield out(keys, n)
                keys, n = keys[:0], n[:0]
    if waiting:
        keys, n = added()
    if len(keys):
        yield out(keys, n)


def pair_counts(documents: DataFrame, name: str = "pairs") -> DataFrame:
    """(pair, n, best): documents that hold each id pair linked, and whether no pair of the same A id has more.

    Pairs are summed up in the tasks that read them. The highest counts are one row for each A id, so at most as many
    as the vocabulary has, and are broadcast.
    """
    counts = stored(documents.select(name).mapInArrow(_lean(_counted), "pair long, n long").groupBy("pair")
                    .agg(F.sum("n").alias("n")), "pair-counts")
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("a")).select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _scored(keys: np.ndarray, n: np.ndarray, best: np.ndarray):
    """For each document the sums over its hot pairs, as a row under a number that is no pair, and its other pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _stretches(batches):
            at = batch.column("at").to_numpy(zero_copy_only=False)
            lengths = np.diff(batch.column("pairs").offsets.to_numpy(zero_copy_only=False))
            pairs = batch.column("pairs").flatten().to_numpy(zero_copy_only=False)
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(at)), lengths)
            place = np.searchsorted(keys, pairs)
            hot = np.zeros(len(pairs), bool)
            if len(keys):
                place = np.minimum(place, len(keys) - 1)
                hot = keys[place] == pairs
            sums = np.zeros(len(at), _I64)
            bests = np.zeros(len(at), _I64)
            np.add.at(sums, of[hot], times[hot] * n[place[hot]])
            np.add.at(bests, of[hot], times[hot] * best[place[hot]])
            cold = ~hot
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((at, at[of[cold]]))), pa.array(np.concatenate((-1 - at, pairs[cold]))),
                 pa.array(np.concatenate((np.zeros(len(at), _I64), times[cold]))),
                 pa.array(np.concatenate((bests, np.zeros(cold.sum(), _I64)))),
                 pa.array(np.concatenate((sums, np.zeros(cold.sum(), _I64))))],
                names=["at", "key", "times", "hot_best", "hot_sum"])

    return run


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
            byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY,
            piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level vocabulary on a space and the text, B the piece vocabulary, which adds that space itself.
    ``n_links`` counts pairs of an A and a B token that share bytes; ``count_sum`` adds, over a document's links, in how
    many documents their id pair is linked, and ``n_best`` counts the links whose pair is its A id's most frequent
    (ties included). ``groups_sha256`` is the digest of the groups as ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts that either tokenizer's tokens do not give back byte for byte, have no tokens:
    zeros and ''. Rows count as documents, so repeated rows and null ids count each on their own; other columns are
    not read; an empty table gives no rows. Both vocabulary files must be there on every executor.
    """
    paths = (byte_vocabulary, piece_vocabulary)
    rows = only(docs, doc_id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("at"), "doc_id", "text")
    first = stored(rows.mapInArrow(_lean(_first_pass(paths, piece_chars)), _DOCUMENT_DDL), "aligned")
    short = first.where("piece IS NULL")
    long = stored(_long_documents(first.where("piece IS NOT NULL"), paths), "aligned-long")
    done = short.unionByName(long)
    counts = stored(pair_counts(done), "pair-best")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # Fewer than HOT_SHARE pairs can hold more than their share of all rows, so this table's size has a bound.
    hot = counts.where(F.col("n") > total / HOT_SHARE).orderBy("pair").toPandas()
    scored = done.select("at", "pairs", "times").mapInArrow(
        _lean(_scored(hot["pair"].to_numpy(_I64), hot["n"].to_numpy(_I64), hot["best"].to_numpy(_I64))),
        "at long, key long, times long, hot_best long, hot_sum long")
    per_document = (scored.join(counts, F.col("key") == F.col("pair"), "left")
                    .groupBy(F.col("at").alias("of"))
                    .agg(F.sum(F.col("hot_best") + F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)))
                         .alias("n_best"),
                         F.sum(F.col("hot_sum") + F.coalesce(F.col("times") * F.col("n"), F.lit(0)))
                         .alias("count_sum")))
    return done.join(per_document, F.col("at") == F.col("of")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
