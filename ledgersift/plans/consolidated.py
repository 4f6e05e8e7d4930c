"""The flagged wide view, grain order x confirmed payment, and what is derived from its flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.functions.expressions import flag, tally
from ledgersift.model import COMPLETED, PAID, Ledger
from ledgersift.operators.facts import look_up, order_facts
from ledgersift.operators.skew import expand

# The five problem flags, in the order of the wide view.
FLAGS = ("no_customer", "no_payment", "amount_mismatch", "null_total", "inactive_product")


def paid_orders(ledger: Ledger, orders: DataFrame) -> DataFrame:
    """Orders left-joined to their confirmed payments, plus ``paid`` and ``has_payment``.

    Orders whose payments all failed or wait get one marker row instead of a payment, so a
    single join also tells whether any payment exists.
    """
    confirmed = (ledger.payments.where(F.col("payment_status") == PAID)
                 .select(F.col("order_id").alias("paid_order_id"), "payment_id", "payment_amount",
                         F.lit(True).alias("paid")))
    only_tried = (ledger.payments.where(F.col("order_id").isNotNull())
                  .groupBy(F.col("order_id").alias("paid_order_id"))
                  .agg(F.count_if(F.col("payment_status") == PAID).alias("confirmed_n"))
                  .where(F.col("confirmed_n") == 0)
                  .select("paid_order_id", F.lit(False).alias("paid")))
    attempts = confirmed.unionByName(only_tried, allowMissingColumns=True)
    pairs = expand(orders, attempts, "order_id", "paid_order_id", how="left",
                   spread_by=["payment_id", "paid_order_id"], parent_spread_by=["total_amount"],
                   hot=ledger.hot("payments", "order_id"))
    return (pairs.drop("parent_found", "paid_order_id", "payment_id")
            .withColumnRenamed("child_found", "has_payment")
            .withColumn("paid", F.coalesce("paid", F.lit(False))))


def _diff():
    known = F.col("paid") & F.col("total_amount").isNotNull()
    return F.when(known, F.col("payment_amount") - F.col("total_amount")).cast("decimal(13,2)")


def _paid_amount():
    return F.coalesce("payment_amount", F.lit(0)).cast("decimal(12,2)")


def consolidated_view(ledger: Ledger) -> DataFrame:
    """Order, customer name, paid amount, product, five 0/1 flags and the difference.

    Names are looked up per order, before payments multiply the rows, unless orders and payments are joined already.
    """
    named = look_up(ledger, ledger.orders if ledger.paid is None else ledger.paid, "customers", found="customer_found",
                    values={"name": "customer_name"})
    described = look_up(ledger, named, "products", found="product_found",
                        values={"product_name": "product_name", "active": "product_active"})
    paired = paid_orders(ledger, described) if ledger.paid is None else described
    return paired.select(
        "order_id", "customer_id", "customer_name", "order_date", "status", "total_amount",
        _paid_amount().alias("paid_amount"), "product_name", "product_active",
        flag(~F.col("customer_found")).alias("no_customer"),
        flag((F.col("status") == COMPLETED) & ~F.col("has_payment")).alias("no_payment"),
        flag(F.abs(_diff()) > 0).alias("amount_mismatch"),
        flag(F.col("total_amount").isNull()).alias("null_total"),
        flag(F.col("product_active") == F.lit(False)).alias("inactive_product"),
        _diff().alias("diff"))


def order_vs_paid(ledger: Ledger) -> DataFrame:
    """Order amount beside paid amount; needs neither customers nor products."""
    paired = paid_orders(ledger, ledger.orders) if ledger.paid is None else ledger.paid
    return paired.select("order_id", "total_amount", _paid_amount().alias("paid_amount"),
                                      _diff().alias("diff"))


def problem_rows(ledger: Ledger, only: Sequence[str] = FLAGS) -> DataFrame:
    """(order_id, problem): one row per raised flag of the wide view, for a problem slicer."""
    raised = F.array(*[F.when(F.col(name) == 1, F.lit(name)) for name in only])
    return consolidated_view(ledger).select("order_id", F.explode(F.array_compact(raised)).alias("problem"))


def order_flags(ledger: Ledger) -> DataFrame:
    """The five flags at order grain, each order once."""
    return order_facts(ledger).select(
        "order_id", "order_date",
        flag(~F.col("customer_found")).alias("no_customer"),
        flag(F.col("unpaid")).alias("no_payment"),
        flag(F.col("mismatched")).alias("amount_mismatch"),
        flag(F.col("total_amount").isNull()).alias("null_total"),
        flag(F.col("product_active") == F.lit(False)).alias("inactive_product"))


def error_trend(ledger: Ledger, unit: str = "day") -> DataFrame:
    """Orders with each problem, and with any, per order date; an order counts once."""
    any_flag = F.greatest(*[F.col(name) for name in FLAGS])
    return (order_flags(ledger).withColumn("period", F.date_trunc(unit, "order_date").cast("timestamp_ntz"))
            .groupBy("period")
            .agg(*[F.sum(tally(F.col(name) == 1)).alias(name) for name in FLAGS],
                 F.sum(tally(any_flag == 1)).alias("any_problem")))
