"""The error trend from flags kept by day: an arrival rewrites the days it touches, a reader reads the days it asks for."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.functions.expressions import tally
from ledgersift.model import Ledger
from ledgersift.plans.consolidated import FLAGS, order_flags

FACTS = "order_id long, " + ", ".join(f"{name} int" for name in FLAGS) + ", day date"


def _day(column: str = "order_date"):
    return F.to_date(column)


def write_days(ledger: Ledger, path: str) -> None:
    """Writes the five flags of the ledger's orders by day of order, undated ones in a partition of their own.

    Only days that the ledger has orders of are replaced. Rows are dealt by ranges of day and order, so a day of very
    many orders is several files.
    """
    facts = order_flags(ledger).withColumn("day", _day()).drop("order_date")
    (facts.repartitionByRange("day", "order_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def touched_days(ledger: Ledger, *, customers: DataFrame | None = None, orders: DataFrame | None = None,
                 payments: DataFrame | None = None) -> DataFrame:
    """(day): the days whose flags the new rows can change, given the ledger with these rows in it.

    New orders touch their own day, payments that of their order, customers those of their orders.
    """
    dated = ledger.orders.select("order_id", "customer_id", _day().alias("day"))
    days = [dated.where("false").select("day")]
    if orders is not None:
        days.append(orders.select(_day().alias("day")))
    if payments is not None:
        paid = payments.select(F.col("order_id").alias("_id")).distinct()
        days.append(dated.join(paid, F.col("order_id") == F.col("_id"), "left_semi").select("day"))
    if customers is not None:
        known = customers.select(F.col("customer_id").alias("_id")).distinct()
        days.append(dated.join(known, F.col("customer_id") == F.col("_id"), "left_semi").select("day"))
    union = days[0]
    for more in days[1:]:
        union = union.unionByName(more.distinct())
    return union.distinct()


def refresh_days(ledger: Ledger, path: str, days: DataFrame) -> None:
    """Works out and writes the flags of some days anew; the other days' files stay as they are.

    Orders of those days and their payments are all that is joined. There are at most as many days as the
    calendar has, so they are broadcast.
    """
    wanted = F.broadcast(days.select(F.col("day").alias("_wanted")).distinct())
    orders = ledger.orders.join(wanted, _day().eqNullSafe(F.col("_wanted")), "left_semi")
    ids = orders.select(F.col("order_id").alias("_id"))
    payments = ledger.payments.join(ids, F.col("order_id") == F.col("_id"), "left_semi")
    write_days(replace(ledger, orders=orders, payments=payments, settled=None, paid=None), path)


def trend(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """Orders with each problem, and with any, per day; given bounds, only those days' files are read."""
    facts = spark.read.schema(FACTS).parquet(path)
    if first is not None:
        facts = facts.where(F.col("day") >= F.lit(first))
    if last is not None:
        facts = facts.where(F.col("day") <= F.lit(last))
    any_flag = F.greatest(*[F.col(name) for name in FLAGS])
    return (facts.groupBy(F.col("day").cast("timestamp_ntz").alias("period"))
            .agg(*[F.sum(tally(F.col(name) == 1)).alias(name) for name in FLAGS],
                 F.sum(tally(any_flag == 1)).alias("any_problem")))
