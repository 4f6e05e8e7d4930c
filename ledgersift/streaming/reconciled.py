"""Orders and payments held against each other while both are still arriving.

Payments are summed up by order and day before they meet orders, so the state of an order holds at most one row for each
day it may be paid on, however often it is paid. An order may be paid on its own day and the ``within`` days after it;
it is closed, and told, once the watermark is later than the end of the last of them, and a day's payments once it is later
than the end of that day.

Watermarks need zoned timestamps, so event times pass through the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgersift.functions.expressions import rows
from ledgersift.model import COMPLETED, PAID

NO_PAYMENT, NO_ORDER = "no payment in time", "no order in time"


def daily_receipts(payments: DataFrame, lateness: str) -> DataFrame:
    """(paid_order_id, paid_until, n_payments, paid): payments by order and day; ``paid_until`` is the day's last moment.

    Payments without order or date are left out: they can never meet an order in time.
    """
    dated = (payments.where(F.col("order_id").isNotNull() & F.col("payment_date").isNotNull())
             .select(F.col("order_id").alias("paid_order_id"), F.col("payment_date").cast("timestamp").alias("paid_at"),
                     "payment_amount").withWatermark("paid_at", lateness))
    return (dated.groupBy(F.window("paid_at", "1 day"), "paid_order_id")
            .agg(rows().alias("n_payments"), F.sum("payment_amount").alias("paid"))
            .select("paid_order_id", F.window_time("window").alias("paid_until"), "n_payments", "paid"))


def open_orders(orders: DataFrame, lateness: str) -> DataFrame:
    """Orders with an id and a date, by the day they were placed on."""
    return (orders.where(F.col("order_id").isNotNull() & F.col("order_date").isNotNull())
            .select("order_id", "customer_id", "status", "total_amount",
                    F.date_trunc("day", F.col("order_date").cast("timestamp")).alias("ordered_day"))
            .withWatermark("ordered_day", lateness))


def _in_time(within: int) -> Column:
    return ((F.col("order_id") == F.col("paid_order_id")) & (F.col("paid_until") >= F.col("ordered_day"))
            & (F.col("paid_until") <= F.col("ordered_day") + F.expr(f"INTERVAL {within + 1} DAYS")))


def absences(orders: DataFrame, payments: DataFrame, *, within: int = 30, lateness: str = "1 day") -> DataFrame:
    """Both kinds of absence from one full outer stream join: problem, order_id, day, n_payments, amount.

    ``no payment in time``: a completed order that no payment, in whatever state, followed within ``within`` days, with
    its total. ``no order in time``: an order id's payments of one day, with their number and sum, that no order
    preceded within as many days. Rows that have no date or no id to wait with are told as they arrive.
    """
    day = F.coalesce("ordered_day", F.date_trunc("day", "paid_until")).cast("timestamp_ntz")
    waiting = open_orders(orders, lateness).join(daily_receipts(payments, lateness), _in_time(within), "full_outer")
    missed = waiting.where((F.col("paid_order_id").isNull() & (F.col("status") == COMPLETED)) | F.col("order_id").isNull())
    zero, paid = F.lit(0).cast("long"), F.col("paid").cast("decimal(24,2)")
    alone = missed.select(
        F.when(F.col("order_id").isNull(), F.lit(NO_ORDER)).otherwise(F.lit(NO_PAYMENT)).alias("problem"),
        F.coalesce("order_id", "paid_order_id").alias("order_id"), day.alias("day"),
        F.coalesce("n_payments", zero).alias("n_payments"),
        F.when(F.col("order_id").isNull(), paid).otherwise(F.col("total_amount")).cast("decimal(24,2)").alias("amount"))
    lone_orders = orders.where((F.col("status") == COMPLETED) & (F.col("order_id").isNull()
                                                                | F.col("order_date").isNull())).select(
        F.lit(NO_PAYMENT).alias("problem"), "order_id", F.date_trunc("day", "order_date").cast("timestamp_ntz").alias("day"),
        zero.alias("n_payments"), F.col("total_amount").cast("decimal(24,2)").alias("amount"))
    lone_payments = payments.where(F.col("order_id").isNull() | F.col("payment_date").isNull()).select(
        F.lit(NO_ORDER).alias("problem"), "order_id",
        F.date_trunc("day", "payment_date").cast("timestamp_ntz").alias("day"),
        F.lit(1).cast("long").alias("n_payments"), F.col("payment_amount").cast("decimal(24,2)").alias("amount"))
    return alone.unionByName(lone_orders).unionByName(lone_payments)


def closed_orders(orders: DataFrame, payments: DataFrame, *, within: int = 30, lateness: str = "1 day") -> DataFrame:
    """Orders whose last day has passed and whose confirmed payments differ from their total, each told once:
    order_id, customer_id, day, total_amount, n_payments, paid_total, diff, diff_type.

    As in the batch reconciliation a completed order without a confirmed payment in time is held against 0, another one
    is not due; an order without total, or whose confirmed payments all lack an amount, is not compared.
    """
    receipts = daily_receipts(payments.where(F.col("payment_status") == PAID), lateness)
    pairs = open_orders(orders, lateness).join(receipts, _in_time(within), "left_outer")
    closed = (pairs.groupBy("order_id", "ordered_day", "customer_id", "status", "total_amount")
              .agg(F.coalesce(F.sum("n_payments"), F.lit(0).cast("long")).alias("n_payments"),
                   F.sum("paid").cast("decimal(24,2)").alias("paid")))
    due = closed.where((F.col("n_payments") > 0) | (F.col("status") == COMPLETED))
    nothing = F.lit(0).cast("decimal(24,2)")
    compared = (due.withColumn("paid_total", F.when(F.col("n_payments") == 0, nothing).otherwise(F.col("paid")))
                .withColumn("diff", (F.col("paid_total") - F.col("total_amount")).cast("decimal(24,2)")))
    return compared.where(F.col("diff") != 0).select(
        "order_id", "customer_id", F.col("ordered_day").cast("timestamp_ntz").alias("day"), "total_amount",
        "n_payments", "paid_total", "diff",
        F.when(F.col("diff") > 0, F.lit("Overpaid")).otherwise(F.lit("Underpaid")).alias("diff_type"))


def append_rows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is known so far as Parquet, exactly once, then stop until the next run."""
    return (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
