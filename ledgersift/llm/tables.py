"""Reading the given tables and cutting lineage through the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.session import remove_folder, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the folder that all executors share."""
    _MADE.append(f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what operators stored within; their results must be written by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        for folder in _MADE[before:]:
            remove_folder(spark, folder)
        del _MADE[before:]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the folder that all executors share, and read back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def batches_of(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, under the operator's own names, so that others cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
