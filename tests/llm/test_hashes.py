"""Hashes of words and lines: equal only for equal bytes, also on strings that collide under any sum of powers."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ledgersift.llm import line_dedup, near_dups, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def morse(n):
    """A Thue-Morse string of n letters and its complement: equal under every sum of odd powers modulo 2^64."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_hash_alike_only_if_alike():
    rng = random.Random(2)
    made = ["", "a", "A", "é", "É", "x" * 31, "x" * 32, "x" * 33, "x" * 40, "X" * 40, *morse(512), *morse(2048)]
    made += ["".join(rng.choices("abAB", k=rng.randrange(1, 70))) for _ in range(3_000)]
    made += ["12345678abcdefgh", "abcdefgh12345678", "\0" * 8, "\0" * 9, "12345678", "12345678\0"]
    body = np.frombuffer("".join(made).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in made])
    got = words.span_hashes(body, ends - [len(w.encode()) for w in made], ends).tolist()
    lower = ["".join(c.lower() if c.isascii() else c for c in w) for w in made]
    assert len(set(got)) == len(set(lower)) == len(set(zip(got, lower, strict=True)))


def test_words_of_a_column_do_not_depend_on_their_neighbours():
    texts = ["one Two  three", None, "", " two ", "x" * 100 + " TWO", "three\tone"]
    hashes, first = words.words(pa.array(texts))
    rows = [hashes[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert [len(r) for r in rows] == [3, 0, 0, 1, 2, 2]
    assert rows[0][1] == rows[3][0] == rows[4][1] and rows[0][0] == rows[5][1] and rows[0][2] == rows[5][0]
    whole, beginnings, _ = words.words_and_beginnings(pa.array(["abcdef abcxyz abc"]), words.NOT_SPACE, 3)
    assert len(set(whole.tolist())) == 3 and len(set(beginnings.tolist())) == 1 and whole[2] == beginnings[0]


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_colliding_lines_stay(spark, n):
    one, other = morse(n)
    df = spark.createDataFrame([(1, one, "", "", 0), (2, one, "", "", 0), (3, other, "", "", 0), (4, other, "", "", 0)], DOCS)
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.without_repeated_lines(df).collect()}
    assert got == {1: (0, one), 2: (0, one), 3: (0, other), 4: (0, other)}


@pytest.mark.parametrize("n", [512, 4096])
def test_colliding_words_are_no_copies(spark, n):
    one, other = morse(n)
    df = spark.createDataFrame([(1, f"{one} {one}", "", "", 0), (2, f"{other} {other}", "", "", 0),
                                (3, f"{one} {one.upper()}", "", "", 0)], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(df, size=2).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1)}
