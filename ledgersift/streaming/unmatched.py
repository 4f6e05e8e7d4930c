"""Completed orders without a payment, found while both tables are still arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgersift.model import COMPLETED


def unpaid_orders(orders: DataFrame, payments: DataFrame, *, within: str = "30 days",
                  lateness: str = "1 day") -> DataFrame:
    """Streaming left-outer join: completed orders that no payment followed within ``within``.

    Absence is only known once the watermark has passed an order's deadline, so an order shows
    up then and not before; the batch check instead answers for the tables as they stand. State
    is kept for open orders and for payments no older than the watermark. Payments of one order
    at the same moment count once: they are dropped where they arrive, spread by order and time,
    so an order paid very often does not fill the join's state. Watermarks need zoned timestamps,
    so event times pass through the session's time zone and back.

    ``reason`` is ``no payment in time`` or, for a completed order without a date, which has no deadline and shows
    up as it arrives, ``undated``.
    """
    completed = orders.where(F.col("status") == COMPLETED)
    undated = completed.where(F.col("order_date").isNull()).select(
        "order_id", "customer_id", "order_date", "total_amount", F.lit("undated").alias("reason"))
    open_orders = (completed.where(F.col("order_date").isNotNull())
                   .select("order_id", "customer_id", "total_amount",
                           F.col("order_date").cast("timestamp").alias("ordered_at"))
                   .withWatermark("ordered_at", lateness))
    receipts = (payments.where(F.col("order_id").isNotNull())
                .select(F.col("order_id").alias("paid_order_id"),
                        F.col("payment_date").cast("timestamp").alias("paid_at"))
                .withWatermark("paid_at", lateness)
                .dropDuplicates(["paid_order_id", "paid_at"]))
    in_time = ((F.col("order_id") == F.col("paid_order_id"))
               & (F.col("paid_at") >= F.col("ordered_at"))
               & (F.col("paid_at") <= F.col("ordered_at") + F.expr(f"INTERVAL {within}")))
    return (open_orders.join(receipts, in_time, "left_outer")
            .where(F.col("paid_order_id").isNull())
            .select("order_id", "customer_id", F.col("ordered_at").cast("timestamp_ntz").alias("order_date"),
                    "total_amount", F.lit("no payment in time").alias("reason"))
            .unionByName(undated))


def write_unpaid(unpaid: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is known so far as Parquet, exactly once, then stop until the next run."""
    return (unpaid.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
