"""The ledger's checks: generic operators applied to the four roles.

Detail checks return unsorted rows; a report order is applied when rows are written or shown
(``plans.catalogue``), since a global sort is a shuffle that most uses do not need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.functions.expressions import money, rows
from ledgersift.model import COMPLETED, PAID, Ledger
from ledgersift.operators import amounts, duplicates, nulls, references
from ledgersift.operators.facts import look_up
from ledgersift.operators.skew import HotKeys, key_set, resolve


def with_customer_name(ledger: Ledger, df: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Add customer_name to rows with customer_id and order_id."""
    return look_up(ledger, df, "customers", found="_customer_found", values={"name": "customer_name"},
                   hot=hot).drop("_customer_found")


def _hot_payers(ledger: Ledger) -> HotKeys:
    """Customers that may be hot among payment rows: those with many orders, or with an order
    that has many payments."""
    buyers, paid_orders = ledger.hot("orders", "customer_id"), ledger.hot("payments", "order_id")
    if isinstance(paid_orders, str):
        return buyers
    payers = (ledger.orders.where(F.col("customer_id").isNotNull())
              .join(F.broadcast(paid_orders), F.col("order_id") == F.col("hot_key"))
              .select(F.col("customer_id").alias("hot_key"), "n_salts"))
    either = payers if isinstance(buyers, str) else buyers.select("hot_key", "n_salts").unionByName(payers)
    return either.groupBy("hot_key").agg(F.sum("n_salts").alias("n_salts"))


def duplicate_emails(ledger: Ledger) -> DataFrame:
    return duplicates.duplicate_groups(ledger.customers, "email", ts="created_at")


def duplicate_email_members(ledger: Ledger) -> DataFrame:
    return duplicates.duplicate_members(ledger.customers, "email", "customer_id", "name", ledger.skew)


def duplicate_email_listing(ledger: Ledger) -> DataFrame:
    """The groups with their customers' ids as text, as the published export has them; a very large group takes
    several rows."""
    blocks = duplicates.listing_blocks(ledger.customers, "email", "customer_id", ts="created_at", policy=ledger.skew)
    return blocks.select("email", "n", "n_extra", "ids", "first_seen", "last_seen")


def duplicate_email_rate(ledger: Ledger) -> DataFrame:
    return duplicates.duplicate_rate(ledger.customers, "email")


def orders_without_customer(ledger: Ledger) -> DataFrame:
    child = ledger.orders.select("order_id", "customer_id", "order_date", "status", "total_amount")
    if ledger.lost_customers is not None:
        return references.orphans_of(child, ledger.lost_customers, "customer_id",
                                     reason=ledger.labels.customer_missing, referenced_as="referenced_customer_id",
                                     spread_by=["order_id"], hot=ledger.hot("orders", "customer_id"))
    return references.orphans(child, ledger.customers, "customer_id", "customer_id",
                              reason=ledger.labels.customer_missing, referenced_as="referenced_customer_id",
                              spread_by=["order_id"], hot=ledger.hot("orders", "customer_id"),
                              small_parent=ledger.small("customers"))


def orders_without_customer_rate(ledger: Ledger) -> DataFrame:
    return references.orphan_rate(ledger.orders, ledger.customers, "customer_id", "customer_id")


def completed_without_payment(ledger: Ledger) -> DataFrame:
    if ledger.settled is not None:
        unpaid = ledger.settled.where(~F.col("payment_found") & (F.col("status") == COMPLETED))
    else:
        unpaid = references.missing_children(ledger.orders, ledger.payments, "order_id", "order_id",
                                             F.col("status") == COMPLETED)
    named = with_customer_name(ledger, unpaid.select("order_id", "customer_id", "order_date", "total_amount"))
    return named.select("order_id", "customer_id", "customer_name", "order_date", "total_amount",
                        F.lit(ledger.labels.completed_unpaid).alias("problem"))


def completed_without_payment_risk(ledger: Ledger) -> DataFrame:
    return references.missing_children_risk(ledger.orders, ledger.payments, "order_id", "order_id",
                                            "total_amount", F.col("status") == COMPLETED)


def orphan_payments(ledger: Ledger) -> DataFrame:
    if ledger.settled is not None:
        return ledger.settled.where(~F.col("order_found")).select(
            "payment_id", F.col("paid_order_id").alias("referenced_order_id"), "payment_date", "payment_amount",
            "payment_status", F.lit(ledger.labels.order_missing).alias("problem"))
    child = ledger.payments.select("payment_id", "order_id", "payment_date", "payment_amount", "payment_status")
    return references.orphans(child, ledger.orders, "order_id", "order_id",
                              reason=ledger.labels.order_missing, referenced_as="referenced_order_id",
                              spread_by=["payment_id"], hot=ledger.hot("payments", "order_id"))


def orphan_payment_amount(ledger: Ledger, coalesce_empty: bool = False) -> DataFrame:
    return references.orphan_amount(ledger.payments, ledger.orders, "order_id", "order_id", "payment_amount",
                                    coalesce_empty=coalesce_empty)


def orphan_payments_by_status(ledger: Ledger) -> DataFrame:
    return references.orphan_amount(ledger.payments, ledger.orders, "order_id", "order_id", "payment_amount",
                                    by="payment_status")


def mismatched_payments(ledger: Ledger, *columns: str) -> DataFrame:
    """Confirmed payments that differ from their order's total, without customer names."""
    if ledger.settled is not None:
        confirmed = ledger.settled.where(F.col("order_found") & F.col("payment_found")
                                         & (F.col("payment_status") == PAID))
        return amounts.with_difference(confirmed, "total_amount", "payment_amount", ledger.labels)
    return amounts.amount_mismatch(
        ledger.orders.select("order_id", *columns, "total_amount"),
        ledger.payments.select("payment_id", "order_id", "payment_amount", "payment_status"),
        "order_id", "order_id", "total_amount", "payment_amount", F.col("payment_status") == PAID,
        child_id="payment_id", labels=ledger.labels, hot=ledger.hot("payments", "order_id"))


def amount_mismatches(ledger: Ledger) -> DataFrame:
    named = with_customer_name(ledger, mismatched_payments(ledger, "customer_id", "order_date"), _hot_payers(ledger))
    return named.select("order_id", "customer_id", "customer_name", "order_date",
                        F.col("total_amount").alias("order_amount"), F.col("payment_amount").alias("paid_amount"),
                        "diff", "diff_type", "diff_pct")


def amount_mismatch_summary(ledger: Ledger) -> DataFrame:
    return amounts.mismatch_summary(mismatched_payments(ledger))


def customers_with_nulls(ledger: Ledger) -> DataFrame:
    words = ledger.labels
    return nulls.null_detail(ledger.customers, ["name", "email"], {
        ("name", "email"): words.both_null, ("name",): words.name_null, ("email",): words.email_null})


def orders_with_null_total(ledger: Ledger) -> DataFrame:
    rows_ = ledger.orders.select("order_id", "customer_id", "order_date", "status", "total_amount")
    return nulls.null_rows(rows_, "total_amount", ledger.labels.total_null)


def null_census(ledger: Ledger, full: bool = True) -> DataFrame:
    tables = {"customers": (ledger.customers, ["name", "email"]),
              "orders": (ledger.orders, ["total_amount", "order_date"] if full else ["total_amount"])}
    if full:
        tables["payments"] = (ledger.payments, ["payment_amount"])
    return nulls.null_census(tables)


def inactive_product_orders(ledger: Ledger) -> DataFrame:
    inactive = ledger.products.where(F.col("active") == F.lit(False))
    met = resolve(ledger.orders, inactive, "product_id", "product_id", found="_sold", spread_by=["order_id"],
                  values={"product_name": "product_name", "price": "product_price", "active": "active"},
                  hot=ledger.hot("orders", "product_id"), small_parent=ledger.small("products"))
    return with_customer_name(ledger, met.where("_sold").drop("_sold")).select(
        "order_id", "customer_id", "customer_name", "order_date", "status", "total_amount",
        "product_id", "product_name", "product_price", "active",
        F.lit(ledger.labels.inactive_product).alias("problem"))


def inactive_product_summary(ledger: Ledger) -> DataFrame:
    """Orders are combined per product before they meet the catalogue."""
    per_product = (ledger.orders.where(F.col("product_id").isNotNull()).groupBy("product_id")
                   .agg(rows().alias("n"), F.sum("total_amount").alias("amount")))
    inactive = key_set(ledger.products.where(F.col("active") == F.lit(False)), "product_id", "_inactive")
    sold = per_product.join(inactive, F.col("product_id") == F.col("_inactive"), "left_semi")
    return sold.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"),
                    F.coalesce(money(F.sum("amount")), F.lit(0).cast("decimal(24,2)")).alias("amount"))


def reconciliation(ledger: Ledger) -> DataFrame:
    """Orders whose total differs from the sum of their confirmed payments (one row per order).

    A completed order without a confirmed payment is compared with 0; other orders without one are not due yet.
    """
    return amounts.reconcile(
        ledger.orders.select("order_id", "customer_id", "order_date", "total_amount", "status"),
        ledger.payments, "order_id", "order_id", "total_amount", F.col("payment_amount"),
        F.col("payment_status") == PAID, due=F.col("status") == COMPLETED).select(
            "order_id", "customer_id", "order_date", "total_amount",
            F.col("n_children").alias("n_payments"), F.col("actual_total").alias("paid_total"), "diff")
