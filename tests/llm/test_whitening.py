"""Whitening against numpy and exact whole-number arithmetic."""

import math

import numpy as np
import pytest

from ledgersift.llm import whitening
from ledgersift.llm.tables import table

SCHEMA = "vec_id long, embedding array<float>, x string, n long, block string, label int"


def brute(rows, components=16):
    """{vec_id: deviation}, n, eigenvalues and projections of the usable vectors, from plain numpy."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not usable:
        return None
    lengths = [len(v) for _, v in usable]
    dim = max(set(lengths), key=lambda d: (lengths.count(d), d))
    whole = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in usable if len(v) == dim]
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    far = [(i, [n * a - s for a, s in zip(x, sums, strict=True)]) for i, x in whole]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return dict(n=n, far=far, values=values[::-1], vectors=vectors[:, ::-1], trace=float((centred**2).sum() / n))


def check(spark, rows, got, want):
    k = len({r.component for r in got})
    assert len(got) == len(want["far"]) * k
    assert {r.n for r in got} == {want["n"]} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error <= 1e-9
    by_id = sorted((str(i), sum(v * v for v in f)) for i, f in want["far"])
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == by_id
    for c in range(1, k + 1):
        own = [r for r in got if r.component == c]
        e = want["values"][c - 1]
        assert {round(r.explained / (e / want["trace"]), 6) for r in own} == {1.0}
        ours = sorted((str(r.vec_id), r.whitened) for r in own)
        theirs = sorted((str(i), float(np.array(f) / want["n"] @ want["vectors"][:, c - 1] / math.sqrt(e)))
                        for i, f in want["far"])
        a, b = np.array([v for _, v in ours]), np.array([v for _, v in theirs])
        assert min(np.abs(a - b).max(), np.abs(np.sort(a) - np.sort(-b)).max(), np.abs(a + b).max()) < 1e-6
    return k


@pytest.fixture(scope="module")
def rows():
    """Usable vectors with repeats and ties, a common vector, and every kind of row that takes no part."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(90, 20)) @ np.diag(np.linspace(3, .2, 20))
    out = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    out += [(200 + k, out[k][1]) for k in range(10)] + [(300 + k, out[0][1]) for k in range(60)] + [out[5], out[5]]
    odd = [None, [], [1.0] * 19, [None] + [1.0] * 19, [float("nan")] * 20, [float("inf")] + [0.0] * 19,
           [float("-inf")] + [0.0] * 19, [0.5] * 21]
    return out + [(900 + k, v) for k, v in enumerate(odd)]


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_equals_numpy(spark, rows, block_rows):
    df = spark.createDataFrame([(i, v, "x", 1, "b", 0) for i, v in rows], SCHEMA).repartition(3)
    got = whitening.whitened(df, block_rows=block_rows).collect()
    assert check(spark, rows, got, brute(rows)) == 16


def test_whole_table_equals_numpy(spark, sf_small):
    df = table(spark, sf_small, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    assert check(spark, rows, whitening.whitened(df).collect(), brute(rows)) == 16


def test_fewer_components_than_asked_for(spark):
    flat = [(k, [float(k), 2.0 * k, 7.0]) for k in range(6)]
    got = whitening.whitened(spark.createDataFrame([(i, v, "x", 1, "b", 0) for i, v in flat], SCHEMA)).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-9
    assert abs(np.var([r.whitened for r in got]) - 1) < 1e-9


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[float("nan")]]])
def test_nothing_to_fit(spark, vectors):
    df = spark.createDataFrame([(k, v, "x", 1, "b", 0) for k, v in enumerate(vectors)], SCHEMA)
    assert whitening.whitened(df).collect() == []


def test_distances_beyond_a_long_are_null():
    far = np.array([[3 * 10**9, 2 * 10**9], [1, 2], [4 * 10**9, 0]], dtype=np.int64)
    assert whitening._squares(far) == [None, 5, None]
    assert whitening._squares(np.array([[3 * 10**9, 2], [1, 2]], dtype=np.int64)) == [9 * 10**18 + 4, 5]
