"""A ledger laid out for its joins: orders and payments bucketed and sorted by order id, so they join without exchange.

A bucket is read by one task, so order ids with very many payments, and rows without order id, are kept apart in tables of
their own: the few hot orders meet their payments in a broadcast join.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.model import PAID, Ledger
from ledgersift.operators.skew import hot_keys

PARTS = ("orders", "payments", "hot_orders", "hot_payments")


@dataclass(frozen=True)
class Layout:
    """The tables of a laid-out ledger. ``hot_orders`` are the orders of the few hot ids, ``hot_payments`` their
    payments and those without order id."""

    tables: Mapping[str, str]
    buckets: int

    def frame(self, spark: SparkSession, part: str) -> DataFrame:
        return spark.table(self.tables[part])


def lay_out(ledger: Ledger, prefix: str, folder: str, *, buckets: int) -> Layout:
    """Writes orders and payments as tables ``<prefix>_*`` under a folder that all executors read.

    One shuffle of each table, once; every later join by order id needs none. About 128 MB a bucket is a good size.
    """
    spark = ledger.orders.sparkSession
    layout = Layout({part: f"{prefix}_{part}" for part in PARTS}, buckets)
    keys = f"{folder}/hot_keys"
    hot_keys(ledger.payments, "order_id", ledger.skew).write.mode("overwrite").parquet(keys)
    hot = F.broadcast(spark.read.schema("hot_key long, n_salts int").parquet(keys).select("hot_key"))

    def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        marked = df.join(hot, F.col("order_id") == F.col("hot_key"), "left")
        apart = F.col("hot_key").isNotNull()
        return marked.where(~apart).drop("hot_key"), marked.where(apart).drop("hot_key")

    orders, hot_orders = split(ledger.orders)
    payments, hot_payments = split(ledger.payments.where(F.col("order_id").isNotNull()))
    alone = ledger.payments.where(F.col("order_id").isNull())
    for part, df in zip(PARTS, (orders, payments, hot_orders, hot_payments.unionByName(alone)), strict=True):
        bucketed = part in ("orders", "payments")
        # One file for each bucket, so that its rows are sorted for the join as they are read.
        writer = (df.repartition(buckets, "order_id") if bucketed else df).write.mode("overwrite").format("parquet")
        if bucketed:
            writer = writer.bucketBy(buckets, "order_id").sortBy("order_id")
        writer.option("path", f"{folder}/{part}").saveAsTable(layout.tables[part])
    return layout


def _hot_pairs(layout: Layout, spark: SparkSession, wanted: Column) -> tuple[DataFrame, DataFrame]:
    """Hot and keyless payments (those ``wanted``) beside their orders, payments without one included; and the orders."""
    orders = layout.frame(spark, "hot_orders")
    payments = layout.frame(spark, "hot_payments").where(wanted).withColumnRenamed("order_id", "paid_order_id")
    known = F.broadcast(orders.withColumn("order_found", F.lit(True)))
    pairs = payments.join(known, F.col("paid_order_id") == F.col("order_id"), "left")
    return pairs.withColumn("order_found", F.coalesce("order_found", F.lit(False))), orders


def laid_out_settlements(layout: Layout, spark: SparkSession) -> DataFrame:
    """``facts.settlements`` of the laid-out ledger, without exchange: orders full-joined to payments."""
    orders = layout.frame(spark, "orders").withColumn("_order", F.lit(True))
    payments = (layout.frame(spark, "payments").withColumnRenamed("order_id", "paid_order_id")
                .withColumn("_payment", F.lit(True)))
    cold = orders.join(payments, F.col("order_id") == F.col("paid_order_id"), "full").withColumns({
        "order_found": F.coalesce("_order", F.lit(False)), "payment_found": F.coalesce("_payment", F.lit(False))})
    hot, _ = _hot_pairs(layout, spark, F.lit(True))
    return cold.drop("_order", "_payment").unionByName(hot.withColumn("payment_found", F.lit(True)))


def laid_out_paid_orders(layout: Layout, spark: SparkSession) -> DataFrame:
    """Orders beside their confirmed payments, plus ``paid`` and ``has_payment``, without exchange (see
    ``consolidated.paid_orders``); an order without a confirmed payment is one row."""
    kept = ("payment_amount",)
    orders, payments = layout.frame(spark, "orders"), layout.frame(spark, "payments")
    confirmed = payments.where(F.col("payment_status") == PAID).select(
        F.col("order_id").alias("_paid_order"), *kept, F.lit(True).alias("paid"))
    any_payment = payments.groupBy(F.col("order_id").alias("_any_order")).agg(F.lit(True).alias("has_payment"))
    cold = (orders.join(confirmed, F.col("order_id") == F.col("_paid_order"), "left")
            .join(any_payment, F.col("order_id") == F.col("_any_order"), "left").drop("_paid_order", "_any_order"))
    hot, hot_orders = _hot_pairs(layout, spark, F.col("payment_status") == PAID)
    met = hot.where("order_found").select(*orders.columns, *kept, F.lit(True).alias("paid"))
    # A hot order always has payments; without a confirmed one it is one row.
    rest = (hot_orders.join(F.broadcast(met.select(F.col("order_id").alias("_met")).distinct()),
                            F.col("order_id") == F.col("_met"), "left_anti")
            .withColumn("paid", F.lit(False)))
    few = met.unionByName(rest, allowMissingColumns=True).withColumn("has_payment", F.lit(True))
    return cold.unionByName(few).withColumns({"paid": F.coalesce("paid", F.lit(False)),
                                              "has_payment": F.coalesce("has_payment", F.lit(False))})


def laid_out(ledger: Ledger, layout: Layout) -> Ledger:
    """The ledger with its joins of orders and payments answered from the layout."""
    spark = ledger.orders.sparkSession
    orders = layout.frame(spark, "orders").unionByName(layout.frame(spark, "hot_orders"))
    payments = layout.frame(spark, "payments").unionByName(layout.frame(spark, "hot_payments"))
    return replace(ledger, orders=orders, payments=payments, settled=laid_out_settlements(layout, spark),
                   paid=laid_out_paid_orders(layout, spark))
