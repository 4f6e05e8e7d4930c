"""Missing values: which rows, which columns, how many."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_detail(df: DataFrame, columns: Sequence[str], wording: dict[tuple[str, ...], str]) -> DataFrame:
    """Rows with a NULL in any of ``columns``, plus ``null_fields`` naming the combination.

    ``wording`` maps column combinations to text; the first one that is wholly NULL applies.
    """
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    text = F.coalesce(*[
        F.when(reduce(lambda a, b: a & b, [F.col(c).isNull() for c in combination]), F.lit(words))
        for combination, words in wording.items()])
    return df.where(any_null).withColumn("null_fields", text)


def null_rows(df: DataFrame, column: str, reason: str) -> DataFrame:
    """Rows where one column is NULL, without that column, plus ``problem``."""
    return df.where(F.col(column).isNull()).drop(column).withColumn("problem", F.lit(reason))


def null_census(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """check_name ("table.column") and n for every listed column; one scan per table."""
    counted = []
    for name, (df, columns) in tables.items():
        one_row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        cells = F.array(*[F.struct(F.lit(f"{name}.{c}").alias("check_name"), F.col(c).alias("n"))
                          for c in columns])
        counted.append(one_row.select(F.inline(cells)))
    return reduce(DataFrame.unionByName, counted)


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that break NOT NULL on any column, plus ``violations`` (the array of those columns)."""
    broken = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return df.withColumn("violations", broken).where(F.size("violations") > 0)
