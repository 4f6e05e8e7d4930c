"""Quality classifier with hierarchical empirical Bayes.

Each document gets classifier evidence, the chance that it is bad (toxic or of poor quality). Summed up by site and
by path within the site, the evidence gives posterior rates: a path is shrunk towards its site and a site towards
the whole corpus, by prior strengths estimated from how much paths and sites differ (method of moments). A document
is then judged by its evidence under the rate of its path in place of the global one; its own share is taken out of
its path's rate first, so that it does not confirm itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.tables import batches_of, only, stored
from ledgersift.llm.words import (
    ALNUM,
    NOT_SPACE,
    U64,
    mix,
    slices,
    text_buffer,
    word_spans,
    words,
    words_and_beginnings,
)

MAX_LABELS = 16_000  # labelled documents the classifier is fitted on, the least by hash of their id
PREFIX = 4  # bytes of a word's beginning
MAX_FEATURES = 4_096
TERMS_AT_ONCE = 1 << 16  # words and beginnings in one batch of the fit
HEADS = ("toxic", "poor")
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[33, 35, 36, 37, 38, 42, 64, 94, 123, 124, 125, 126]] = True
_UPPER, _DIGIT, _BREAK = (np.zeros(256, dtype=bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_BREAK[10] = True


@dataclass(frozen=True)
class Model:
    """Weights of both heads: for words by hash, and for the shape of the text."""

    vocabulary: np.ndarray
    word_weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    shape_weights: np.ndarray
    bias: np.ndarray


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(flags), offsets)).astype(np.float64)


def shapes(column: pa.Array) -> np.ndarray:
    """What a text looks like, one row each: shares of symbols, capitals, digits, repeats and so on."""
    body, offsets = text_buffer(column)
    size = np.maximum(np.diff(offsets), 1)
    starts, ends = word_spans(body, offsets, NOT_SPACE)
    first = np.searchsorted(starts, offsets)
    n_words = np.maximum(np.diff(first), 1)
    hashes, _ = words(column)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    symbol_end = _SYMBOLS[body[ends - 1]] if len(ends) else np.zeros(0, dtype=bool)
    all_upper = _UPPER[body[starts]] & _UPPER[body[np.minimum(starts + 1, ends - 1)]] if len(ends) else symbol_end
    distinct = np.array([len(np.unique(hashes[a:b], sorted=False)) for a, b in zip(first[:-1], first[1:], strict=True)], float)
    out = [_sums(_SYMBOLS[body], offsets) / size, _sums(_UPPER[body], offsets) / size,
           _sums(_DIGIT[body], offsets) / size, _sums(_BREAK[body], offsets) / n_words,
           _sums(same, first) / n_words, _sums(symbol_end, first) / n_words, _sums(all_upper, first) / n_words,
           distinct / n_words, np.log1p(n_words), size / n_words / 10, np.log1p(distinct)]
    shape = np.stack(out, axis=1) if len(size) else np.zeros((0, len(out)))
    return np.concatenate((shape, np.sqrt(np.abs(shape[:, :7])), (shape[:, :7] > 0.02)), axis=1)


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes for each word, its own and that of its beginning, and the index of each row's first."""
    whole, start, first = words_and_beginnings(column, ALNUM, PREFIX)
    both = np.empty(2 * len(whole), dtype=U64)
    both[::2], both[1::2] = whole, mix(start, 5)
    return both, 2 * first


def _features(batches):
    """For each text a row with its shape, and one for each of its distinct words and word beginnings."""
    for batch in batches:
        for part in slices(batch, "text"):
            terms, first = _terms(part.column("text"))
            shape = pa.array(list(shapes(part.column("text"))), pa.list_(pa.float64()))
            heads = [part.column(head) for head in HEADS]
            yield batches_of(["row", *HEADS, "shape", "term"],
                             [part.column("row"), *heads, shape, pa.nulls(part.num_rows, pa.int64())])
            distinct = [np.unique(terms[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            owner = pa.array(np.repeat(np.arange(part.num_rows), [len(d) for d in distinct]))
            found = pa.array(np.concatenate(distinct).view(np.int64))
            for at in range(0, len(found), TERMS_AT_ONCE):
                of, term = owner.slice(at, TERMS_AT_ONCE), found.slice(at, TERMS_AT_ONCE)
                yield batches_of(["row", *HEADS, "shape", "term"],
                                 [part.column("row").take(of), *[head.take(of) for head in heads],
                                  pa.nulls(len(of), shape.type), term])


def _places(vocabulary: np.ndarray, row_ids: np.ndarray):
    """The vocabulary's words among the terms, by their place in it and that of their row among the sorted ids."""
    def run(batches):
        for batch in batches:
            terms = batch.column("term").to_numpy().view(U64)
            at = np.searchsorted(vocabulary, terms)
            at[at == len(vocabulary)] = 0
            hit = np.flatnonzero(vocabulary[at] == terms) if len(vocabulary) else at[:0]
            of = np.searchsorted(row_ids, batch.column("row").to_numpy()[hit])
            yield batches_of(["row", "place"], [pa.array(of, pa.int32()), pa.array(at[hit], pa.int16())])
    return run


def _gain(bad_with: str, n: float, bad: float) -> Column:
    """How far a word's share of bad documents is from the others', as a likelihood ratio statistic."""
    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(F.lit(0.0))
    times, hit = F.col("times"), F.col(bad_with)
    rate = times / F.lit(n)
    return 2 * (part(hit, bad * rate) + part(times - hit, (n - bad) * rate) + part(bad - hit, bad * (1 - rate))
                + part((n - bad) - (times - hit), (n - bad) * (1 - rate)))


def _summing(index: np.ndarray, n: int):
    """A function that sums values by their index, which comes sorted."""
    starts = np.flatnonzero(np.diff(index, prepend=-1))
    keys = index[starts]

    def sums(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(starts):
            out[keys] = np.add.reduceat(values, starts)
        return out
    return sums


def _logistic(rows: np.ndarray, cols: np.ndarray, shape: np.ndarray, n_cols: int, target: np.ndarray, steps: int = 600,
              decay: float = 2e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """Regularised logistic regression on word presence and shape, by Adam over the whole sample.

    ``rows`` (sorted) and ``cols`` are the places where a document has a word.
    """
    n, k = shape.shape
    w = np.zeros(n_cols + k + 1)
    w[-1] = np.log((target.sum() + 1) / (n - target.sum() + 1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = np.where(target > 0, 3.0, 1.0) / n  # a bad document let through costs more than a good one lost
    row_sums = _summing(rows, n)
    by_col = np.argsort(cols, kind="stable")
    col_sums = _summing(cols[by_col], n_cols)
    rows = rows[by_col]
    del by_col
    gathered = np.empty(len(cols))  # used again in each step
    for step in range(1, steps + 1):
        z = row_sums(np.take(w, cols, out=gathered, mode="clip")) + shape @ w[n_cols:-1] + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        g = np.concatenate((col_sums(np.take(error, rows, out=gathered, mode="clip")), shape.T @ error, [error.sum()])) + decay * w
        g[-1] -= decay * w[-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:n_cols], w[n_cols:-1], w[-1]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_labels: int = MAX_LABELS) -> Model:
    """The classifier, fitted on at most ``max_labels`` labelled documents (labels: doc_id, quality, toxic).

    The sample is bounded, so it may be broadcast; each of its rows is used, copies too. Words are counted and chosen
    on Spark; the driver gets the chosen words and, of each document, its shape and the chosen words it has. Rows with
    a null label or id do not count; without labels, all weights are 0 and nothing is rejected.
    """
    chosen = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
              .groupBy("doc_id").agg((F.max("toxic") > 0).cast("double").alias("toxic"),
                                     (F.min("quality") <= 0).cast("double").alias("poor"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels))
    rows = only(docs, doc_id=id_col, text=text_col)
    found = stored(rows.join(F.broadcast(chosen), "doc_id")
                   .select("text", *HEADS, F.monotonically_increasing_id().alias("row"))
                   .mapInArrow(_features, "row long, toxic double, poor double, shape array<double>, term long"),
                   "features")
    one, terms = found.where("term IS NULL").drop("term"), found.where("term IS NOT NULL").drop("shape")
    n, *bad = one.agg(F.count(F.lit(1)), F.sum("toxic"), F.sum("poor")).first()
    n_shape = shapes(pa.array([""])).shape[1]
    if not n:
        return Model(np.zeros(0, U64), np.zeros((0, 2)), np.zeros(n_shape), np.ones(n_shape), np.zeros((n_shape, 2)),
                     np.full(2, -5.0))
    counted = (terms.groupBy("term")
               .agg(F.count(F.lit(1)).alias("times"), F.sum("toxic").alias("toxic"), F.sum("poor").alias("poor"))
               .where("times >= 4"))
    gains = stored(counted.select("term", *[_gain(head, n, bad[k]).alias(head) for k, head in enumerate(HEADS)])
                   .where(F.greatest(*HEADS) > 10.8), "gains")
    picked = [gains.where(F.col(head) > 10.8).orderBy(F.desc(head), "term").limit(MAX_FEATURES // 2)
              .select("term").collect() for head in HEADS]
    vocabulary = np.unique(np.array([r["term"] for rows_ in picked for r in rows_], dtype=np.int64).view(U64))
    sample = one.toPandas().sort_values("row")
    # A place takes 6 bytes on its way: the vocabulary is below 32,768 words.
    hits = (terms.select("row", "term").mapInArrow(_places(vocabulary, sample["row"].to_numpy()), "row int, place short")
            .toArrow())
    target = sample[list(HEADS)].to_numpy()
    shape = np.array(sample["shape"].tolist(), dtype=np.float64)
    centre, scale = shape.mean(axis=0), np.maximum(shape.std(axis=0), 1e-6)
    shape = np.clip((shape - centre) / scale, -8, 8)
    rows_, cols = hits.column("row").to_numpy(), hits.column("place").to_numpy()
    del hits
    order = np.argsort(rows_, kind="stable")
    rows_, cols = rows_[order].astype(np.intp), cols[order].astype(np.intp)
    del order
    fitted = [_logistic(rows_, cols, shape, len(vocabulary), target[:, head]) for head in range(2)]
    return Model(vocabulary, np.stack([f[0] for f in fitted], 1), centre, scale,
                 np.stack([f[1] for f in fitted], 1), np.array([f[2] for f in fitted]))


def evidence(column: pa.Array, model: Model) -> np.ndarray:
    """Log odds of being toxic and of being poor, one row for each text."""
    out = np.clip((shapes(column) - model.centre) / model.scale, -8, 8) @ model.shape_weights + model.bias
    hashes, first = _terms(column)
    if len(model.vocabulary) and len(hashes):
        leading = np.zeros(1 << 16, dtype=bool)  # most words are told apart from the vocabulary by their first bits
        leading[(model.vocabulary >> U64(48)).astype(np.int64)] = True
        hit = np.flatnonzero(leading[(hashes >> U64(48)).astype(np.int64)])
        place = np.searchsorted(model.vocabulary, hashes[hit])
        place[place == len(model.vocabulary)] = 0
        same = model.vocabulary[place] == hashes[hit]
        hit, place = hit[same], place[same]
        row = np.searchsorted(first, hit, side="right") - 1
        once = np.unique(row * len(model.vocabulary) + place)
        row, place = once // len(model.vocabulary), once % len(model.vocabulary)
        for head in range(2):
            out[:, head] += np.bincount(row, model.word_weights[place, head], len(out))
    return np.clip(out, -30, 30)


def scorer(model: Model):
    """An Arrow function of the text: its log odds of being toxic and of being poor."""
    @F.arrow_udf("struct<toxic: double, poor: double>")
    def score(texts: pa.Array) -> pa.Array:
        parts = [evidence(p.column(0), model) for p in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text")]
        both = np.concatenate(parts) if parts else np.zeros((0, 2))
        return pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["toxic", "poor"])
    return score


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def _bad(score: str) -> Column:
    """Chance of being toxic or poor."""
    good = _sigmoid(-F.col(f"{score}.toxic")) * _sigmoid(-F.col(f"{score}.poor"))
    return F.least(F.greatest(F.lit(1.0) - good, F.lit(1e-9)), F.lit(1 - 1e-9))


def _strength(rates: DataFrame, n: str, own: str, above: str) -> DataFrame:
    """Prior strength by the method of moments: how far the rates differ beyond what their sizes explain."""
    spread = F.sum(F.col(n) * F.pow(F.col(own) - F.col(above), 2)) / F.sum(n)
    chance = F.sum(F.col(above) * (1 - F.col(above))) / F.sum(n)
    inner = F.sum(F.col(n) * F.col(above) * (1 - F.col(above))) / F.sum(n)
    between = F.greatest(spread - chance, F.lit(1e-6))
    return rates.agg(F.least(F.greatest(inner / between - 1, F.lit(1.0)), F.lit(1e6)).alias("strength"))


def path_rates(scored: DataFrame) -> DataFrame:
    """(site, path, n, bad, global_rate, site_rate, strength): the shrunk site rate that each path's rate leans on.

    ``scored`` has site, path and p_bad; null sites and paths are groups of their own.
    """
    # Written once, a row for each path: what follows reads it several times and must not score the texts again.
    paths = stored(scored.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p_bad").alias("bad")),
                   "paths")
    sites = paths.groupBy("site").agg(F.sum("n").alias("site_n"), F.sum("bad").alias("site_bad"))
    whole = sites.agg((F.sum("site_bad") / F.sum("site_n")).alias("global_rate"))
    rates = sites.join(F.broadcast(whole)).withColumn("own", F.col("site_bad") / F.col("site_n"))  # one row
    site_strength = _strength(rates, "site_n", "own", "global_rate").withColumnRenamed("strength", "site_strength")
    shrunk = rates.join(F.broadcast(site_strength)).select(  # one row
        "site", "global_rate", ((F.col("site_bad") + F.col("site_strength") * F.col("global_rate"))
                                / (F.col("site_n") + F.col("site_strength"))).alias("site_rate"))
    placed = paths.join(shrunk, paths["site"].eqNullSafe(shrunk["site"])).drop(shrunk["site"])
    strength = _strength(placed.withColumn("own", F.col("bad") / F.col("n")), "n", "own", "site_rate")
    return placed.join(F.broadcast(strength))  # one row


def _scored(docs: DataFrame, model: Model, text_col: str, site_col: str, path_col: str, *more: Column) -> DataFrame:
    """(__site, __path, __score, __p) of each document, and ``more`` columns."""
    return (docs.select(*more, F.col(f"`{site_col}`").cast("string").alias("__site"),
                        F.col(f"`{path_col}`").cast("string").alias("__path"),
                        scorer(model)(F.col(f"`{text_col}`")).alias("__score")).withColumn("__p", _bad("__score")))


def _rates(scored: DataFrame) -> DataFrame:
    rates = path_rates(scored.select(F.col("__site").alias("site"), F.col("__path").alias("path"),
                                     F.col("__p").alias("p_bad")))
    return rates.withColumnsRenamed({"site": "__of_site", "path": "__of_path"}
                                    | {c: f"__{c}" for c in ("n", "bad", "global_rate", "site_rate", "strength")})


def _verdict() -> Column:
    """The verdict on a document whose score stands beside its path's rates."""
    others = F.greatest(F.col("__bad") - F.col("__p"), F.lit(0.0))
    rate = ((others + F.col("__strength") * F.col("__site_rate"))
            / (F.greatest(F.col("__n") - 1, F.lit(0)) + F.col("__strength")))
    bad = _sigmoid(_logit(F.col("__p")) + _logit(rate) - _logit(F.col("__global_rate")))
    return F.struct(_sigmoid(F.col("__score.toxic")).alias("toxic"), _sigmoid(F.col("__score.poor")).alias("poor"),
                    rate.alias("path_rate"), bad.alias("bad"), (bad < 0.5).alias("keep"))


def judge(docs: DataFrame, model: Model, text_col: str = "text", site_col: str = "source",
          path_col: str = "lang") -> DataFrame:
    """``docs`` with ``__verdict``: toxic and poor (chances), path_rate, bad (chance given the path) and keep.

    Null and empty texts are judged by their (empty) shape. Documents are scored twice, once for the rates and once
    with them at hand, so that no text is shuffled or written: a text meets its path's rate in one join by site and
    path.
    """
    rates = _rates(_scored(docs, model, text_col, site_col, path_col))
    met = docs.join(rates, F.col(f"`{site_col}`").cast("string").eqNullSafe(F.col("__of_site"))
                    & F.col(f"`{path_col}`").cast("string").eqNullSafe(F.col("__of_path")), "left")
    met = met.withColumn("__score", scorer(model)(F.col(f"`{text_col}`"))).withColumn("__p", _bad("__score"))
    return met.withColumn("__verdict", _verdict()).drop(*rates.columns, "__score", "__p")


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             site_col: str = "source", path_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, toxic, poor, path_rate, bad, keep.

    Without texts in the result, documents are scored once: their scores are written, a few bytes each.
    """
    model = fit(docs, labels, id_col, text_col)
    scored = stored(_scored(docs, model, text_col, site_col, path_col, F.col(f"`{id_col}`").alias("__id")), "scores")
    rates = _rates(scored)
    met = scored.join(rates, F.col("__site").eqNullSafe(F.col("__of_site"))
                      & F.col("__path").eqNullSafe(F.col("__of_path")), "left")
    return met.select(F.col("__id").alias("doc_id"), _verdict().alias("__verdict")).select("doc_id", "__verdict.*")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             site_col: str = "source", path_col: str = "lang") -> DataFrame:
    """``docs`` without those rejected, under the docs' own columns."""
    judged = judge(docs, fit(docs, labels, id_col, text_col), text_col, site_col, path_col)
    return judged.where("__verdict.keep").drop("__verdict")
