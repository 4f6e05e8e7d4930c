"""Whitening of embeddings with MLlib's block matrices.

Rows become whole numbers, so that sums, means and distances are exact. Centred rows are packed into blocks where they
are read, numbered through over all tasks, and form a BlockMatrix. Its transpose times itself is the scatter, worked
out in splits of a fixed number of blocks, so that no task meets all of them. The scatter (dimension x dimension, whatever the
number of rows) is decomposed on the driver, and a second product with the whitening matrix projects all rows, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ledgersift.llm.tables import new_folder, only, stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Rows of a block, and blocks that one task multiplies at once. With 64 dimensions a block is 512 KB.
BLOCK_ROWS = 1024
SPLIT_BLOCKS = 16
#: The driver knows the numbers of all blocks of a product; blocks grow once there would be more than so many.
MOST_BLOCKS = 1 << 18
#: Components with less than this part of the variance are not told apart from rounding and are left out.
LEAST_SHARE = 1e-12

_MATRIX_DDL = ("struct<type:tinyint,numRows:int,numCols:int,colPtrs:array<int>,rowIndices:array<int>,"
               "values:array<double>,isTransposed:boolean>")
_ARROW_MATRIX = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()),
                           ("colPtrs", pa.list_(pa.int32())), ("rowIndices", pa.list_(pa.int32())),
                           ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): floor(SCALE * c) + SHIFT of each entry, rows with a null or non-finite entry or vector left out.

    The table's dimension is that of most rows (of the larger, if two are as frequent); rows of another one are left out,
    and so are empty vectors.
    """
    rows = only(vectors, vec_id=id_col, v=vector_col).select(
        "vec_id", F.transform("v", lambda c: c.cast("double")).alias("v"))
    # NaN counts as larger than all numbers, so one comparison finds it and the infinities.
    usable = F.forall("v", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    whole = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & usable).select(
        "vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT).cast("long")).alias("x"))
    kept = stored(whole, "whole")
    sizes = kept.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d"))
    d = sizes.first()
    return kept.where(F.size("x") == (d["d"] if d else 0))


def _centred(n: int, sums: np.ndarray, block_rows: int, ids: bool) -> Callable:
    """Packs rows (vec_id, x) into blocks: number within the task, ids, squared distances, and the centred matrix.

    n * x - sums is exact in 64 bits, so the centred value is rounded once, in the division by n. A task's last block is
    filled up with zeros, which change neither a scatter nor another row.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, held, number = [], [], 0, 0

        def block(x: np.ndarray, of: list) -> pa.RecordBatch:
            nonlocal number
            far = n * x - sums
            full = np.zeros((block_rows, len(sums)))
            full[:len(x)] = far / n
            flat = full.ravel(order="F")
            one = pa.array([0, len(flat)], pa.int32())
            nothing = pa.nulls(1, pa.list_(pa.int32()))
            matrix = pa.StructArray.from_arrays(
                [pa.array([1], pa.int8()), pa.array([block_rows], pa.int32()), pa.array([len(sums)], pa.int32()),
                 nothing, nothing, pa.ListArray.from_arrays(one, pa.array(flat)), pa.array([False])],
                fields=list(_ARROW_MATRIX))
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number - 1], pa.int64()), pa.array([of], pa.list_(pa.int64())),
                 pa.array([_squares(far) if ids else []], pa.list_(pa.int64())), matrix],
                names=["local", "ids", "deviation", "matrix"])

        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("x")
            parts.append(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums)))
            names += batch.column("vec_id").to_pylist() if ids else []
            held += batch.num_rows
            if held >= block_rows:
                x = np.concatenate(parts)
                for k in range(0, held - block_rows + 1, block_rows):
                    yield block(x[k:k + block_rows], names[k:k + block_rows])
                rest = held % block_rows
                parts, names, held = [x[held - rest:]], names[held - rest:] if ids else [], rest
        if held:
            yield block(np.concatenate(parts), names)

    return pack


def _squares(far: np.ndarray) -> list:
    """Exact sums of squares by row; null where one exceeds a long."""
    most = int(np.abs(far).max()) if far.size else 0
    if most * most * far.shape[1] < 2**63:
        return (far * far).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in far.tolist()]
    return [v if v < 2**63 else None for v in exact]


def _blocks(rows: DataFrame, n: int, sums: np.ndarray, block_rows: int, ids: bool) -> DataFrame:
    """Stored blocks (block, ids, deviation, matrix), numbered from 0 without gaps, the matrix in MLlib's type."""
    spark = rows.sparkSession
    plain = f"local long, ids array<long>, deviation array<long>, matrix {_MATRIX_DDL}"
    path = new_folder(spark, "blocks")
    (rows.select("vec_id", "x").mapInArrow(_centred(n, sums, block_rows, ids), plain)
     .withColumn("part", F.spark_partition_id()).write.parquet(path))
    schema = T.StructType([*T._parse_datatype_string("local long, ids array<long>, deviation array<long>, part int"),
                           T.StructField("matrix", MatrixUDT())])
    packed = spark.read.schema(schema).parquet(path)
    # One row for each task that packed; the sums over them number the blocks through.
    counts = packed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    return packed.join(F.broadcast(base), "part").select((F.col("base") + F.col("local")).alias("block"), "ids",
                                                         "deviation", "matrix")


def _as_matrix(blocks: DataFrame, block_rows: int, dim: int) -> BlockMatrix:
    at = F.struct(F.col("block").alias("i"), F.lit(0).cast("long").alias("j")).alias("at")
    java = callMLlibFunc("createBlockMatrix", blocks.select(at, "matrix"), block_rows, dim,
                         blocks.count() * block_rows, dim)
    return BlockMatrix(java, block_rows, dim)


def _scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times itself. The rows' dimension is cut into splits, each summed up by its own task."""
    splits = max(1, math.ceil(matrix.numRowBlocks / SPLIT_BLOCKS))
    product = matrix.transpose()._java_matrix_wrapper.call(
        "multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _times(spark: SparkSession, matrix: BlockMatrix, local: np.ndarray) -> BlockMatrix:
    """The product with a small matrix, which travels as one block."""
    rows, cols = local.shape
    block = spark.sparkContext.parallelize([((0, 0), DenseMatrix(rows, cols, local.ravel(order="F")))], 1)
    return matrix.multiply(BlockMatrix(block, rows, cols, rows, cols))


def _unpacked(components: int) -> Callable:
    """Rows (vec_id, component, deviation, whitened) of projected blocks with their ids; filling is left out."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, deviation, matrix in zip(*(batch.column(c) for c in ("ids", "deviation", "matrix")), strict=True):
                ids, deviation = ids.values, deviation.values
                values = matrix["values"].values.to_numpy(zero_copy_only=False)
                order = "C" if matrix["isTransposed"].as_py() else "F"
                values = values.reshape(-1, components, order=order)[:len(ids)]
                row = np.repeat(np.arange(len(ids)), components)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), len(ids))),
                     deviation.take(pa.array(row)), pa.array(values.ravel())],
                    names=["vec_id", "component", "deviation", "whitened"])

    return unpack


RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *,
             components: int = COMPONENTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    A vector's entries c become whole numbers x = floor(64 c) + 1000000. The transform is fitted on each distinct x
    once: n of them, with sums S. ``whitened`` is x - S / n on the component's unit eigenvector, over the root of its
    eigenvalue; ``explained`` is the eigenvalue's part of the variance; ``deviation`` is the exact sum of (n x - S)^2
    (null where that exceeds a long); ``identity_error`` is the largest entry of the whitened fit list's covariance minus the
    identity. Components come by falling eigenvalue, at most ``components``; those without variance of their own
    (a rank below the dimension, or a single vector) are left out, since nothing can be scaled to 1 there.

    Null and empty vectors, and those with a null or non-finite entry or of another length than most, give no rows; a
    null id stays null, repeated rows are all returned, other columns are not read, an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, id_col, vector_col)
    fit = stored(rows.select(F.lit(None).cast("long").alias("vec_id"), "x").distinct(), "fit")
    first = fit.first()
    if first is None:
        return spark.createDataFrame([], RESULT)
    dim = len(first["x"])
    found = fit.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[k]) for k in range(dim)]).first()
    n, sums = found[0], np.array(found[1:], dtype=np.int64)
    block_rows = max(block_rows, math.ceil(rows.count() / MOST_BLOCKS))
    centred = _as_matrix(_blocks(fit, n, sums, block_rows, False), block_rows, dim)
    covariance = _scatter(centred) / n
    values, columns = np.linalg.eigh((covariance + covariance.T) / 2)
    values, columns = values[::-1], columns[:, ::-1]
    total = float(np.trace(covariance))
    k = min(components, int((values > LEAST_SHARE * total).sum()) if total > 0 else 0)
    if not k:
        return spark.createDataFrame([], RESULT)
    transform = columns[:, :k] / np.sqrt(values[:k])
    error = float(np.abs(_scatter(_times(spark, centred, transform)) / n - np.eye(k)).max())
    blocks = _blocks(rows, n, sums, block_rows, True)
    projected = _times(spark, _as_matrix(blocks, block_rows, dim), transform)
    product = callMLlibFunc("getMatrixBlocks", projected._java_matrix_wrapper._java_model)
    product = product.select(F.col("_1._1").alias("of"), F.col("_2").alias("matrix"))
    explained = F.element_at(F.array(*[F.lit(float(v / total)) for v in values[:k]]), F.col("component"))
    return (blocks.drop("matrix").join(product, F.col("block") == F.col("of")).select("ids", "deviation", "matrix")
            .mapInArrow(_unpacked(k), "vec_id long, component int, deviation long, whitened double")
            .select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    explained.alias("explained"), F.lit(error).alias("identity_error")))
