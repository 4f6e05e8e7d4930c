"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's rows are dealt by hash into blocks, more of them the larger the source is. A source's quota is a number of
block draws: whole passes over its blocks, for the rest of its target blocks taken in a random order as long as they
fit, and at last the part of one more block that fills the target up to a document. All draws are then split among
output shards by a tree: a node holds how many draws of each source its shards get, and hands a
multivariate-hypergeometric part of them to its left half. Every shard walks from the root to its leaf on its own, so
no task and not the driver holds the tree. A shard's draws of a source are a run of the source's permuted draws, which
makes the shards disjoint; rows are shuffled within a shard by hash.

Rows are dealt by id and text, so the mix does not depend on how the table is written. Rows that share both are told apart by
their place in their file, so they too fall into different blocks; a frame that is not read from files goes by its
partitions instead and has to be the same each time it is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ledgersift.llm.tables import stored
from ledgersift.llm.words import NOT_SPACE, slices, text_buffer, word_spans

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3  # times that a source may be repeated
#: Words of a block; a source has as many blocks as that makes, and ``LEAST_BLOCKS`` at least.
BLOCK_WORDS = 500_000
LEAST_BLOCKS = 256
MAX_SOURCES = 100_000  # one row of each source is on the driver
SHARD_WORDS = 2_000_000


@F.arrow_udf(T.LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Runs without ASCII white space; a null has none."""
    counts = [np.zeros(0, np.int64)]
    for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
        body, offsets = text_buffer(part.column(0))
        starts, _ = word_spans(body, offsets, NOT_SPACE)
        counts.append(np.diff(np.searchsorted(starts, offsets)))
    return pa.array(np.concatenate(counts), pa.int64())


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS,
            most: float = MOST) -> dict[str | None, float]:
    """Each source's target: its weight's share of the whole, at most ``most`` times its size.

    Weights go to the sources by code point, null last, and repeat. What a source cannot take is shared among the
    others by weight, again until none is above its limit.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {name: weights[k % len(weights)] for k, (name, _) in enumerate(order)}
    limit = {name: most * size for name, size in order}
    left, given = float(sum(size for _, size in order)), {}
    open_ = [name for name, _ in order]
    while open_:
        share = left / sum(weight[name] for name in open_)
        above = [name for name in open_ if share * weight[name] > limit[name]]
        if not above:
            given |= {name: share * weight[name] for name in open_}
            break
        for name in above:
            given[name] = float(limit[name])
            left -= limit[name]
        open_ = [name for name in open_ if name not in given]
    return given


def _draws(seed: int):
    """A source's draws in permuted order: whole passes over its blocks, then the blocks that fit in the rest, and a
    part of one more block, with the words to take of it."""
    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        sizes, size, target = blocks["words"].to_numpy(), int(blocks["source_size"].iloc[0]), blocks["target"].iloc[0]
        rng = np.random.default_rng([seed, int(blocks["rank"].iloc[0])])
        passes = min(int(target // size), MOST) if size else 0
        rest, chosen = target - passes * size, []
        order = rng.permutation(len(blocks))
        for k in order:
            if 0 < sizes[k] <= rest:
                chosen.append(k)
                rest -= sizes[k]
        others = [k for k in order if sizes[k] > 0 and k not in set(chosen)]
        part = others[:1] if passes < MOST and rest > 0 else []
        drawn = np.concatenate([rng.permutation(len(blocks)) for _ in range(passes)] + [np.array(chosen + part, dtype=int)])
        epoch = np.concatenate([np.full(len(blocks), e) for e in range(passes)] + [np.full(len(chosen + part), passes)])
        wanted = np.full(len(drawn), np.nan)
        wanted[len(drawn) - len(part):] = rest
        return pd.DataFrame({"rank": blocks["rank"].iloc[0], "block": blocks["block"].to_numpy()[drawn.astype(int)],
                             "epoch": epoch, "place": np.arange(len(drawn)), "wanted": wanted})
    return run


def _cut(draws: DataFrame, sized: DataFrame) -> DataFrame:
    """Draws plus ``cut``: of a part of a block, the last place in the block's order that is taken; else null.

    A document is taken if at least half of it still fits, so the part misses its words by half a document at most.
    Only the rows of those blocks, one of each source, are ordered.
    """
    parts = draws.where("wanted IS NOT NULL").select("rank", "block", "wanted")
    before = W.partitionBy("rank", "block").orderBy("order").rowsBetween(W.unboundedPreceding, -1)
    taken = (sized.where("size > 0").join(F.broadcast(parts), ["rank", "block"])
             .withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
             .where(F.col("before") + F.col("size") / 2 <= F.col("wanted"))
             .groupBy("rank", "block").agg(F.max("order").alias("cut")))
    whole = draws.where("wanted IS NULL").drop("wanted").withColumn("cut", F.lit(None).cast("long"))
    return whole.unionByName(draws.where("wanted IS NOT NULL").drop("wanted").join(taken, ["rank", "block"]))


def _leaves(quotas: np.ndarray, n_shards: int, seed: int):
    """Each shard's run of draws of every source, found by walking from the root to the shard."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                low, high, counts, start = 0, n_shards, quotas.copy(), np.zeros(len(quotas), np.int64)
                while high - low > 1:
                    middle = (low + high) // 2
                    n_left = int(round(counts.sum() * (middle - low) / (high - low)))
                    rng = np.random.default_rng([seed, low, high])
                    left = rng.multivariate_hypergeometric(counts, n_left, method="marginals")
                    if shard < middle:
                        high, counts = middle, left
                    else:
                        low, start, counts = middle, start + left, counts - left
                has = np.flatnonzero(counts)
                yield pd.DataFrame({"rank": has, "shard": shard, "start": start[has], "n": counts[has]})
    return run


@dataclass(frozen=True)
class Mixture:
    """The plan of a mix: documents with their blocks, sources with their targets, and draws with their shards."""

    sized: DataFrame  # doc_id, size, rank, block, order (one row per document)
    sources: DataFrame  # source, rank, n_blocks, source_size, target
    repeated: DataFrame  # content (of rows that share id and text)
    draws: DataFrame  # rank, block, epoch, cut, shard
    seed: int

    def taken(self) -> DataFrame:
        """One row per document: doc_id, size, source_size, target, taken, and the number of its draws."""
        drawn = self.draws.groupBy("rank", "block").agg(F.count_if(F.col("cut").isNull()).alias("whole"),
                                                        F.max("cut").alias("cut"))
        n_draws = F.coalesce("whole", F.lit(0)) + F.when(F.col("order") <= F.col("cut"), F.lit(1)).otherwise(F.lit(0))
        met = self.sized.join(drawn, ["rank", "block"], "left").withColumn("n_draws", n_draws.cast("long"))
        return (met.join(F.broadcast(self.sources.drop("n_blocks")), "rank")
                .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_draws")).alias("taken"),
                        "n_draws"))

    def rows(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
        """``docs`` as often as drawn, with ``__shard``, each shard in one partition and in random order."""
        whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                            F.col(f"`{source_col}`").cast("string").alias("source"),
                            *_identity(docs, id_col, text_col))
        dealt = _dealt(whole, self.sources, self.repeated, self.seed, "row")
        drawn = self.draws.select(F.col("rank").alias("of"), F.col("block").alias("drawn"), "epoch", "cut", "shard")
        met = dealt.join(drawn, (F.col("rank") == F.col("of")) & (F.col("block") == F.col("drawn"))
                         & (F.col("cut").isNull() | (F.col("order") <= F.col("cut"))))
        return (met.select("row", F.col("shard").alias("__shard"), "epoch",
                           F.xxhash64(F.lit(self.seed), "shard", "epoch", "order").alias("at"))
                .repartition("__shard").sortWithinPartitions("__shard", "at", "epoch").select("row.*", "__shard"))


def _identity(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """What rows are dealt by: their id and text, and the place that tells apart rows which share both."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
        place = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:  # not read from files
        place = F.monotonically_increasing_id()
    return [F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("content"), place.alias("place")]


def _dealt(rows: DataFrame, sources: DataFrame, repeated: DataFrame, seed: int, *kept: str) -> DataFrame:
    """Rows (source, content, place) with their source's rank, their block and their order in it."""
    named = F.broadcast(sources.select(F.col("source").alias("name"), "rank", "n_blocks"))
    again = repeated.select(F.col("content").alias("again"))
    own = F.when(F.col("again").isNotNull(), F.col("place")).otherwise(F.lit(0).cast("long"))
    key = F.xxhash64(F.lit(seed), "content", own)
    return (rows.join(named, F.col("source").eqNullSafe(F.col("name")))
            .join(again, F.col("content") == F.col("again"), "left")
            .select(*kept, "rank", F.pmod(key, "n_blocks").cast("int").alias("block"),
                    F.xxhash64(F.lit(seed + 1), "content", own).alias("order")))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            seed: int = 11, shard_words: int = SHARD_WORDS) -> Mixture:
    """Plans the mix of ``docs``. Sizes are numbers of words; a null or empty text has size 0 and is never drawn
    for a rest. A null source is a source of its own. Equal rows are drawn one by one.
    """
    counted = stored(docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                                 F.col(f"`{source_col}`").cast("string").alias("source"),
                                 word_count(F.col(f"`{text_col}`")).alias("size"),
                                 *_identity(docs, id_col, text_col)), "sized")
    repeated = stored(counted.groupBy("content").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("content"),
                      "repeated")
    spark = docs.sparkSession
    totals = counted.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = sorted(((r["source"], r["size"]) for r in totals), key=lambda s: (s[0] is None, s[0] or ""))
    given = targets(sizes)
    sources = spark.createDataFrame(
        [(name, rank, max(LEAST_BLOCKS, -(-size // BLOCK_WORDS)), size, given[name])
         for rank, (name, size) in enumerate(sizes)],
        "source string, rank int, n_blocks int, source_size long, target double")
    sized = _dealt(counted, sources, repeated, seed, "doc_id", "size")
    blocks = (sized.groupBy("rank", "block").agg(F.sum("size").alias("words"))
              .join(F.broadcast(sources.select("rank", "source_size", "target")), "rank"))
    draws = stored(_cut(blocks.groupBy("rank").applyInPandas(
        _draws(seed), "rank int, block int, epoch int, place long, wanted double"), sized), "draws")
    quotas = np.zeros(max(len(sizes), 1), np.int64)
    for row in draws.groupBy("rank").agg((F.max("place") + 1).alias("n")).collect():
        quotas[row["rank"]] = row["n"]
    n_shards = max(1, -(-sum(size for _, size in sizes) // shard_words))
    slices_ = min(n_shards, spark.sparkContext.defaultParallelism * 4)
    runs = (spark.range(0, n_shards, 1, slices_).mapInPandas(
        _leaves(quotas, n_shards, seed), "rank int, shard long, start long, n long"))
    placed = runs.select("rank", "shard", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("place"))
    return Mixture(sized, sources, repeated, stored(draws.join(placed, ["rank", "place"]).drop("place"), "placed"), seed)
