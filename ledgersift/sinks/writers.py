"""Writes results as CSV or Parquet. Nothing passes through the driver."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgersift.operators.controls import tag


def dated_path(folder: str, stem: str, day: date, kind: str = "csv") -> str:
    """``<folder>/<stem>_<YYYYMMDD>.<kind>``; a second run on the same day replaces the first."""
    return f"{folder}/{stem}_{day:%Y%m%d}.{kind}"


def write_result(df: DataFrame, path: str, kind: str = "csv", single_file: bool = False) -> int:
    """Write and return the number of rows, counted while writing.

    ``single_file`` is for summaries of a few rows only; detail results keep their partitions.
    """
    counted = Observation()
    observed = df.observe(counted, F.count(F.lit(1)).alias("rows"))
    writer = (observed.coalesce(1) if single_file else observed).write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).option("encoding", "UTF-8").csv(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown result kind {kind!r}")
    return counted.get["rows"]


def write_split(df: DataFrame, rules: dict[str, Column], path: str) -> None:
    """Clean and quarantined rows from one pass: ``verdict=clean`` and ``verdict=quarantine``."""
    tagged = tag(df, rules)
    verdict = F.when(F.size("broken_rules") == 0, F.lit("clean")).otherwise(F.lit("quarantine"))
    tagged.withColumn("verdict", verdict).write.mode("overwrite").partitionBy("verdict").parquet(path)
