"""Benchmark decontamination by greedy string tiling.

Documents and test items meet on seeds, runs of ``seed`` shared words. Only the stretches of a document that are
made of seeds leave the scan: every tile of at least ``seed`` words lies inside one, so tiling over the stretches
equals tiling over the text. Tiles are found by running Karp-Rabin matching: windows of a search length are hashed,
the longest non-overlapping matches are marked first, and the search length then shrinks to ``seed``. An item
counts as leaked when tiles cover enough of it, in whatever order they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.tables import batches_of, binaries, only, stored
from ledgersift.llm.words import ALNUM, U64, grams, mix, slices, words

SEED = 5
COVERAGE = 0.5
FILTER_BITS = 24  # size of the seed filter: 2 MB, whatever the benchmark's size


def _tokens(seed: int):
    """Each item's words and, in order, the seeds they form."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = words(part.column("text"), ALNUM)
                every = grams(hashes, seed)
                spans = list(zip(first[:-1], first[1:], strict=True))
                seeds = [every[a:max(a, b - seed + 1)].view(np.int64) for a, b in spans]
                yield batches_of(["item_id", "n_words", "tokens", "seeds"],
                                 [part.column("item_id"), np.diff(first).astype(np.int64),
                                  binaries([hashes[a:b].tobytes() for a, b in spans]),
                                  pa.array(seeds, pa.list_(pa.int64()))])
    return run


def _stretches(seed: int, bits: np.ndarray, width: int):
    """The stretches of each document whose every run of ``seed`` words passes the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = words(part.column("text"), ALNUM)
                every = grams(hashes, seed)
                row = np.searchsorted(first, np.arange(len(every)), side="right") - 1
                slot = every >> U64(64 - width)
                hit = ((bits[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1)).astype(bool)
                hit &= np.arange(len(every)) + seed <= first[row + 1]
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                new = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(row[at]) > 0)))
                starts = at[new]
                ends = at[np.concatenate((new[1:], [True]))] + 1
                owners = row[starts]
                yield batches_of(["doc_id", "start", "tokens", "seeds"],
                                 [part.column("doc_id").take(pa.array(owners)),
                                  (starts - first[owners]).astype(np.int64),
                                  binaries([hashes[a:b + seed - 1].tobytes()
                                            for a, b in zip(starts, ends, strict=True)]),
                                  pa.array([every[a:b].view(np.int64) for a, b in zip(starts, ends, strict=True)],
                                           pa.list_(pa.int64()))])
    return run


def _windows(tokens: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of unmarked tokens."""
    if len(tokens) < length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    taken = np.concatenate(([0], np.cumsum(~free)))
    starts = np.flatnonzero(taken[length:] == taken[:-length])
    base = U64(0x9E3779B97F4A7C15)
    power = np.full(len(tokens), base, dtype=U64)
    power[0] = 1
    with np.errstate(over="ignore"):
        power = np.cumprod(power, dtype=U64)
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(tokens) * power, dtype=U64)))
        # Each window's sum is raised to the same power of the base, so that equal windows have equal values.
        value = (total[starts + length] - total[starts]) * power[len(tokens) - 1 - starts]
    return starts, value


def tiles(doc: np.ndarray, gaps: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in doc, start in item, length), longest first.

    ``gaps`` marks tokens of ``doc`` that no tile may use (borders between stretches).
    """
    free_doc, free_item = ~gaps, np.ones(len(item), dtype=bool)
    found: list[tuple[int, int, int]] = []
    length = max(least, len(item) // 2)
    while length >= least:
        at_doc, in_doc = _windows(doc, free_doc, length)
        at_item, in_item = _windows(item, free_item, length)
        # Hashes are comparable between the two sides only after their different lengths are evened out.
        scale = U64(pow(0x9E3779B97F4A7C15, abs(len(doc) - len(item)), 2**64))
        with np.errstate(over="ignore"):
            if len(doc) < len(item):
                in_doc = in_doc * scale
            else:
                in_item = in_item * scale
        places: dict[int, list[int]] = {}
        for start, value in zip(at_item.tolist(), in_item.tolist(), strict=True):
            places.setdefault(value, []).append(start)
        matches = []
        for index in np.flatnonzero(np.isin(in_doc, in_item)).tolist():
            d = int(at_doc[index])
            for i in places[int(in_doc[index])]:
                if d and i and free_doc[d - 1] and free_item[i - 1] and doc[d - 1] == item[i - 1]:
                    continue  # part of the match that starts one word earlier
                n = 0
                while (d + n < len(doc) and i + n < len(item) and free_doc[d + n] and free_item[i + n]
                       and doc[d + n] == item[i + n]):
                    n += 1
                if n >= length:
                    matches.append((-n, d, i))
        longest = -min(matches)[0] if matches else 0
        if longest > 2 * length:
            length = longest
            continue
        for n, d, i in sorted(matches):
            n = -n
            if free_doc[d:d + n].all() and free_item[i:i + n].all():
                free_doc[d:d + n] = False
                free_item[i:i + n] = False
                found.append((d, i, n))
        if matches:
            continue  # what longer tiles cut short is looked at again at this length
        length = max(least, length // 2) if length > least else 0
    return found


def _tile_rows(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_tiles, covered, longest = [], [], []
            for k in range(batch.num_rows):
                item = np.frombuffer(batch.column("item_tokens")[k].as_py(), dtype=U64)
                parts = sorted((s["start"], s["tokens"]) for s in batch.column("stretches")[k].as_py())
                pieces, gaps = [], []
                for _, tokens in parts:
                    piece = np.frombuffer(tokens, dtype=U64)
                    pieces += [piece, np.zeros(1, U64)]
                    gaps += [np.zeros(len(piece), dtype=bool), np.ones(1, dtype=bool)]
                found = tiles(np.concatenate(pieces), np.concatenate(gaps), item, seed)
                n_tiles.append(len(found))
                covered.append(sum(t[2] for t in found))
                longest.append(max((t[2] for t in found), default=0))
            yield batches_of(["doc_id", "item_id", "n_words", "n_tiles", "covered", "longest"],
                             [batch.column("doc_id"), batch.column("item_id"), batch.column("n_words"),
                              pa.array(n_tiles, pa.int64()), pa.array(covered, pa.int64()),
                              pa.array(longest, pa.int64())])
    return run


def _seed_filter(seeds: DataFrame, width: int) -> np.ndarray:
    """A bit for each seed's leading bits. The driver gets at most 2**width bits, at any benchmark size."""
    slot = F.shiftrightunsigned("seed", 64 - width)
    filled = (seeds.select(F.shiftright(slot, 6).alias("word"),
                           F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(seed, {64 - width}) & 63 AS INT))").alias("bit"))
              .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas())
    bits = np.zeros(max(1, 2**width >> 6), dtype=np.int64)
    bits[filled["word"].to_numpy(dtype=np.int64)] = filled["bits"].to_numpy(dtype=np.int64)
    return bits.view(U64)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED,
          coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_words, n_tiles, covered, longest, coverage) for each item that a document holds.

    Words are runs of ASCII letters and digits and all non-ASCII characters, A-Z lower-cased. Null and empty texts
    hold nothing; an item of fewer than ``seed`` words cannot be found. Rows that share a doc_id count as one
    document, and equal item rows as one; rows without id are compared too and come back with a null id.
    ``covered`` counts the item's words under tiles, and coverage = covered / n_words.
    """
    items = stored(only(benchmark, item_id=item_col, text=item_text_col)
                   .withColumn("item_id", F.col("item_id").cast("long"))
                   .mapInArrow(_tokens(seed), "item_id long, n_words long, tokens binary, seeds array<long>")
                   .where(F.size("seeds") > 0).dropDuplicates(["item_id", "tokens"]), "items")
    seeds = items.select("item_id", F.col("tokens").alias("item_tokens"), "n_words",
                         F.explode("seeds").alias("seed"))
    bits = _seed_filter(seeds, FILTER_BITS)
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    stretches = stored(rows.mapInArrow(_stretches(seed, bits, FILTER_BITS),
                                       "doc_id long, start long, tokens binary, seeds array<long>"), "stretches")
    places = seeds.groupBy("seed", "item_id", "item_tokens", "n_words").agg(F.count(F.lit(1)).alias("times"))
    # A seed covers ``seed`` words at each place it has, which bounds the coverage of a pair from above.
    met = (stretches.select("doc_id", "start", "tokens", F.explode(F.array_distinct("seeds")).alias("seed"))
           .join(places, "seed")
           .groupBy("doc_id", "item_id", "item_tokens", "n_words", "start", "tokens")
           .agg(F.sum("times").alias("times")))
    pairs = (met.groupBy("doc_id", "item_id", "item_tokens", "n_words")
             .agg(F.sum("times").alias("times"), F.collect_list(F.struct("start", "tokens")).alias("stretches"))
             .where(F.col("times") * seed >= coverage * F.col("n_words")))
    tiled = pairs.drop("times").mapInArrow(
        _tile_rows(seed), "doc_id long, item_id long, n_words long, n_tiles long, covered long, longest long")
    return (tiled.withColumn("coverage", F.col("covered") / F.col("n_words"))
            .where(F.col("covered") >= coverage * F.col("n_words")))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold an item, under the docs' own columns; rows without id stay."""
    found = leaks(docs, benchmark, id_col, **options).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(found, F.col(f"`{id_col}`") == F.col("__leaked"), "left_anti")
