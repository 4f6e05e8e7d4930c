"""Exact top-k inner-product search by aggregation without random access.

Vectors are packed into blocks as they are scanned, and each block of queries meets each block of candidates in one
task. There, every component is a list of the block's candidates sorted by value, read from the end that a query's
sign makes best. After each round of reading, a candidate's score has a lower and an upper bound: components already
read count as they are, others as the list's worst or as the value just reached. A query stops when the bounds
leave no more than a few candidates besides its k best; only theirs are then resolved to final scores. A bound
reached on one block carries over to the task's next block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgersift.llm.tables import batches_of, binaries, only

K = 5
BLOCK = 1_024  # vectors of a block
ROUNDS = (64, 8, 2, 1)  # a round reads each list to 1/64, 1/8, ... of its length
SCALE = 256


def quantised(column: pa.ListArray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """floor(SCALE * x) of the usable vectors: by dimension, their rows and their matrix."""
    column = column.cast(pa.large_list(pa.float64()))
    lengths = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()], dtype=np.int64)
    flat = column.flatten()
    nulls = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        values = np.floor(SCALE * values)
    bad = nulls | ~np.isfinite(values)
    at = np.concatenate(([0], np.cumsum(np.maximum(lengths, 0))))
    n_bad = np.concatenate(([0], np.cumsum(bad)))
    usable = (lengths >= 0) & (n_bad[at[1:]] == n_bad[at[:-1]])
    out = {}
    for dim in np.unique(lengths[usable]).tolist():
        rows = np.flatnonzero(usable & (lengths == dim))
        out[dim] = rows, values[at[rows][:, None] + np.arange(dim)]
    return usable, out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = 0
    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
        _, by_dim = quantised(batch.column("embedding"))
        dims, counts, names, matrices, numbers = [], [], [], [], []
        for dim, (rows, matrix) in by_dim.items():
            for k in range(0, len(rows), BLOCK):
                dims.append(dim)
                counts.append(len(rows[k:k + BLOCK]))
                names.append(ids[rows[k:k + BLOCK]].tobytes())
                matrices.append(matrix[k:k + BLOCK].astype(np.float64).tobytes())
                numbers.append(number)
                number += 1
        yield batches_of(["dim", "n", "ids", "matrix", "number"],
                         [pa.array(dims, pa.int32()), pa.array(counts, pa.int32()), binaries(names),
                          binaries(matrices), pa.array(numbers, pa.int64())])


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int,
                  bound: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (places in the block, final scores) of what may be among its k best; raises ``bound``."""
    n = len(vectors)
    span = np.abs(queries).sum(axis=1).max(initial=0) * np.abs(vectors).max(initial=0)
    kind = np.float32 if span < 2**24 else np.float64  # whole numbers that the type holds exactly
    up, down = np.maximum(queries, 0).astype(kind), np.maximum(-queries, 0).astype(kind)
    vectors_ = vectors.astype(kind)
    lists = np.sort(vectors_, axis=0)
    own = query_ids[:, None] == ids[None, :]
    others = n - own.sum(axis=1)
    left = np.arange(len(queries))
    out: list = [None] * len(queries)
    for part in ROUNDS:
        depth = max(1, n // part)
        high, low = lists[n - depth], lists[depth - 1]
        upper = up[left] @ np.maximum(vectors_, high).T - down[left] @ np.minimum(vectors_, low).T
        if depth == n:
            lower = upper
        else:
            lower = (up[left] @ np.where(vectors_ >= high, vectors_, lists[0]).T
                     - down[left] @ np.where(vectors_ <= low, vectors_, lists[-1]).T)
        lower = np.where(own[left], -np.inf, lower)
        upper = np.where(own[left], -np.inf, upper)
        if n >= k:
            kth = -np.partition(-lower, k - 1, axis=1)[:, k - 1]
            bound[left] = np.maximum(bound[left], np.where(others[left] >= k, kth, -np.inf))
        open_ = (upper >= bound[left][:, None]) & ~own[left]
        few = (open_.sum(axis=1) <= max(4 * k, n // 32)) | (depth == n)
        for row in np.flatnonzero(few):
            places = np.flatnonzero(open_[row])
            q = left[row]
            if span < 2**53:
                scores = (vectors[places] @ queries[q]).astype(np.int64)
            else:
                scores = (vectors[places].astype(np.int64) * queries[q].astype(np.int64)).sum(axis=1)
            if len(places) >= k:
                bound[q] = max(bound[q], np.sort(scores)[-k])
            order = np.lexsort((ids[places], -scores))[:k]
            out[q] = places[order], scores[order]
        left = left[~few]
        if not len(left):
            break
    return out


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds: dict[int, np.ndarray] = {}
        held, queries, query_ids = None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column("dim")[row].as_py()
                name = batch.column("q_name")[row].as_py()
                if name != held:
                    query_ids = np.frombuffer(batch.column("q_ids")[row].as_py(), dtype=np.int64)
                    queries = np.frombuffer(batch.column("q_matrix")[row].as_py()).reshape(len(query_ids), dim)
                    held, bounds = name, {name: np.full(len(query_ids), -np.inf)}
                ids = np.frombuffer(batch.column("ids")[row].as_py(), dtype=np.int64)
                vectors = np.frombuffer(batch.column("matrix")[row].as_py()).reshape(len(ids), dim)
                best = best_of_block(queries, query_ids, vectors, ids, k, bounds[name])
                sizes = [len(b[0]) for b in best]
                places = np.concatenate([b[0] for b in best]).astype(np.int64)
                yield batches_of(["query_id", "vec_id", "score"],
                                 [np.repeat(query_ids, sizes), ids[places],
                                  np.concatenate([b[1] for b in best]).astype(np.int64)])
    return run


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding",
          k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best others by integer inner product, ties to smaller vec_id.

    ``is_query`` is a condition on the column vec_id. Vectors that are null or hold null or non-finite components,
    and rows without vec_id, take no part. Rows with the query's own vec_id are no candidates; repeated query rows
    count once and repeated candidate rows each count. Vectors of different length are not compared. Scores are
    exact while they stay below 2**63.
    """
    rows = (only(vectors, vec_id=id_col, embedding=vector_col).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
            .withColumn("vec_id", F.col("vec_id").cast("long")))
    packed = "dim int, n int, ids binary, matrix binary, number long"
    spark = vectors.sparkSession
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = (rows.mapInArrow(_packed, packed)
              .withColumn("slot", F.pmod(F.xxhash64("ids", "number"), F.lit(slots)).cast("int")))
    asked = (rows.where(is_query).dropDuplicates(["vec_id", "embedding"]).mapInArrow(_packed, packed)
             .select("dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"),
                     F.xxhash64("ids", "matrix").alias("q_name"),
                     F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")))
    pairs = (blocks.join(asked.hint("shuffle_merge"), ["dim", "slot"])
             .select("dim", "ids", "matrix", "q_ids", "q_matrix", "q_name"))
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
