"""Scorecards kept over time: one row per run and table, and what changed between two runs."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.model import Ledger
from ledgersift.plans.scorecard import quality_score


def dated_scorecard(ledger: Ledger, run_date: date) -> DataFrame:
    """The scorecard keyed by run date."""
    return quality_score(ledger).withColumn("run_date", F.lit(run_date))


def append_scorecard(ledger: Ledger, run_date: date, path: str) -> None:
    """Write one day's scorecard; running the same day again replaces only that day."""
    (dated_scorecard(ledger, run_date).coalesce(1).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path))


def score_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """table_name, score_before, score_after, score_delta, bad_before, bad_after.

    A table present in only one of the scorecards keeps NULLs on the other side.
    """
    old = before.select("table_name", F.col("score").alias("score_before"), F.col("bad").alias("bad_before"))
    new = after.select("table_name", F.col("score").alias("score_after"), F.col("bad").alias("bad_after"))
    delta = F.col("score_after").cast("decimal(10,2)") - F.col("score_before").cast("decimal(10,2)")
    return (old.join(new, "table_name", "full")
            .select("table_name", "score_before", "score_after", delta.cast("double").alias("score_delta"),
                    "bad_before", "bad_after"))


def as_of(ledger: Ledger, moment: str) -> Ledger:
    """The ledger restricted to customers, orders and payments dated before ``moment``, or not dated at all: an
    undated row is not known to be later, and leaving it out would hide its defects from every earlier day."""
    cut = F.lit(moment).cast("timestamp_ntz")

    def before(df: DataFrame, column: str) -> DataFrame:
        return df.where(F.col(column).isNull() | (F.col(column) < cut))

    return replace(ledger, customers=before(ledger.customers, "created_at"),
                   orders=before(ledger.orders, "order_date"), payments=before(ledger.payments, "payment_date"),
                   settled=None, lost_customers=None, paid=None, counted={})
