"""Shared frames from which most metrics are plain aggregates.

``settlements``      one row per (order, payment) pair, per order without payment and per payment
                     without order: the whole reconciliation from one join of the two tables;
``order_facts``      one row per order with its payment totals, customer and product;
``identity_facts``   one row per email;
``order_book``       one row: orders, bad orders and orphan payments, with customer existence
                     joined to orders already combined per customer id.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.functions.expressions import keep, rows, tally
from ledgersift.model import COMPLETED, FOREIGN_KEYS, PAID, Ledger
from ledgersift.operators.references import lost_keys
from ledgersift.operators.skew import HotKeys, expand, key_set, largest, resolve

PARENT_KEYS = {"customers": "customer_id", "products": "product_id"}


def look_up(ledger: Ledger, df: DataFrame, parent: str, *, found: str, values: dict[str, str] | None = None,
            hot: HotKeys | None = None) -> DataFrame:
    """Rows with order_id and a customer or product id, plus ``found`` and the parent's columns."""
    key = PARENT_KEYS[parent]
    return resolve(df, getattr(ledger, parent), key, key, found=found, values=values, spread_by=["order_id"],
                   hot=ledger.hot("orders", key) if hot is None else hot, small_parent=ledger.small(parent))


def settlements(ledger: Ledger) -> DataFrame:
    """Orders full-joined to payments of any status, plus ``order_found`` and ``payment_found``."""
    if ledger.settled is not None:
        return ledger.settled
    payments = ledger.payments.withColumnRenamed("order_id", "paid_order_id")
    pairs = expand(ledger.orders, payments, "order_id", "paid_order_id", how="full",
                   spread_by=["payment_id"], parent_spread_by=["total_amount"],
                   hot=ledger.hot("payments", "order_id"))
    return (pairs.withColumnRenamed("parent_found", "order_found")
            .withColumnRenamed("child_found", "payment_found"))


def count_hot_keys(ledger: Ledger, folder: str) -> Ledger:
    """The ledger with its hot keys counted once and written to a shared folder: one scan of orders, for both of their
    foreign keys, and one of payments. Plans made of it count nothing; the folder is the caller's to remove."""
    schema = "hot_key long, n_salts int, role string, key string"
    for role in dict.fromkeys(role for role, _ in FOREIGN_KEYS):
        keys = [key for r, key in FOREIGN_KEYS if r == role]
        each = getattr(ledger, role).select(F.inline(F.array(*[
            F.struct(F.lit(key).alias("key"), F.col(key).alias("hot_key")) for key in keys])))
        counts = each.where(F.col("hot_key").isNotNull()).groupBy("key", "hot_key").agg(rows().alias("key_rows"))
        (largest(counts, ledger.skew, "key").write.mode("overwrite").partitionBy("key")
         .parquet(f"{folder}/hot_keys/role={role}"))
    kept = ledger.orders.sparkSession.read.schema(schema).parquet(f"{folder}/hot_keys")
    return replace(ledger, counted={
        (role, key): kept.where((F.col("role") == role) & (F.col("key") == key)).select("hot_key", "n_salts")
        for role, key in FOREIGN_KEYS})


def share_facts(ledger: Ledger, folder: str) -> Ledger:
    """The ledger with facts that many checks need written to a shared folder.

    Hot keys are small tables, so later checks count nothing again; unknown customer ids are a key list; settlements are partitioned by what was found, so
    orders without payment and payments without order are read alone. Being tables, they have a
    known size and survive the loss of executors; the folder is the caller's to remove.
    """
    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    ledger = count_hot_keys(ledger, folder)
    lost = lost_keys(ledger.orders, ledger.customers, "customer_id", "customer_id")
    ledger = replace(ledger, lost_customers=stored(lost, "lost_customers"))
    side = (F.when(~F.col("payment_found"), F.lit("order_only"))
            .when(~F.col("order_found"), F.lit("payment_only")).otherwise(F.lit("pair")))
    path = f"{folder}/settlements"
    sided = settlements(ledger).withColumn("side", side).drop("order_found", "payment_found")
    sided.write.mode("overwrite").partitionBy("side").parquet(path)
    read_back = sided.sparkSession.read.schema(sided.schema).parquet(path)
    return replace(ledger, settled=read_back.withColumns({
        "order_found": F.col("side") != "payment_only", "payment_found": F.col("side") != "order_only"}).drop("side"))


def _diff() -> Column:
    """payment - order amount of a confirmed payment; NULL when either amount is missing."""
    return keep(F.col("payment_status") == PAID, F.col("payment_amount") - F.col("total_amount"))


def settlement_measures() -> dict[str, Column]:
    """Per-row measures of ``settlements`` that add up to the payment side of the audit."""
    unpaid = ~F.col("payment_found") & (F.col("status") == COMPLETED)
    orphan = ~F.col("order_found")
    diff = _diff()
    return {
        "payments": tally(F.col("payment_found")),
        "payment_amount_null": tally(F.col("payment_found") & F.col("payment_amount").isNull()),
        "unpaid": tally(unpaid),
        "unpaid_amount": keep(unpaid, F.col("total_amount")),
        "orphan_payments": tally(orphan),
        "orphan_amount": keep(orphan, F.col("payment_amount")),
        "over": tally(diff > 0),
        "over_amount": keep(diff > 0, diff),
        "under": tally(diff < 0),
        "under_amount": keep(diff < 0, -diff),
    }


def order_measures() -> dict[str, Column]:
    """Per-row measures of ``orders`` that need no join."""
    return {
        "total_null": tally(F.col("total_amount").isNull()),
        "date_null": tally(F.col("order_date").isNull()),
        "gross_amount": keep(F.col("status") == COMPLETED, F.col("total_amount")),
    }


def settlement_totals(ledger: Ledger) -> DataFrame:
    """One row: the sums of all settlement measures (sums over nothing are NULL)."""
    measures = settlement_measures()
    return (settlements(ledger).select(*[c.alias(n) for n, c in measures.items()])
            .agg(*[F.sum(n).alias(n) for n in measures]))


def identity_facts(ledger: Ledger) -> DataFrame:
    """One row per email (and one for NULL): n, name_null, shared, and bad rows.

    A customer row is bad when its name is missing or its email is shared.
    """
    per_email = ledger.customers.groupBy("email").agg(
        rows().alias("n"), F.count_if(F.col("name").isNull()).alias("name_null"))
    shared = F.col("email").isNotNull() & (F.col("n") > 1)
    return (per_email.withColumn("shared", shared)
            .withColumn("bad", F.when(shared, F.col("n")).otherwise(F.col("name_null"))))


def payments_per_order(payments: DataFrame) -> DataFrame:
    """One row per referenced order (and one for none): any_n, paid_n, paid_sum, and the paid
    amounts' extremes. Payments are combined before the shuffle, so no order is hot."""
    paid = keep(F.col("payment_status") == PAID, F.col("payment_amount"))
    return (payments.groupBy(F.col("order_id").alias("_paid_order"))
            .agg(rows().alias("any_n"), F.count_if(F.col("payment_status") == PAID).alias("paid_n"),
                 F.sum(paid).alias("paid_sum"), F.min(paid).alias("paid_min"), F.max(paid).alias("paid_max")))


def paid_order_rows(ledger: Ledger) -> DataFrame:
    """Orders full-joined to their payment totals; ``order_found`` is false for totals whose
    order does not exist, ``any_n`` is NULL for orders without payment."""
    found = ledger.orders.withColumn("_found", F.lit(True))
    totals = payments_per_order(ledger.payments)
    return (found.join(totals, F.col("order_id") == F.col("_paid_order"), "full")
            .withColumn("order_found", F.coalesce("_found", F.lit(False))).drop("_found", "_paid_order"))


def order_facts(ledger: Ledger) -> DataFrame:
    """One row per order: order columns, payment totals, ``unpaid`` (completed, no payment in any
    state), ``mismatched`` (some confirmed payment differs from the total), customer_found and
    product_active.

    A payment differs exactly when the smallest or the largest does, so no payment rows are kept.
    Both flags are worked out before the lookups, which then carry fewer columns.
    """
    totals = payments_per_order(ledger.payments)
    mismatched = (F.col("paid_min") != F.col("total_amount")) | (F.col("paid_max") != F.col("total_amount"))
    paid = (ledger.orders.join(totals, F.col("order_id") == F.col("_paid_order"), "left").drop("_paid_order")
            .withColumn("any_n", F.coalesce("any_n", F.lit(0).cast("long")))
            .withColumns({"unpaid": (F.col("status") == COMPLETED) & (F.col("any_n") == 0),
                          "mismatched": F.coalesce(mismatched, F.lit(False))}))
    with_customer = look_up(ledger, paid, "customers", found="customer_found")
    return look_up(ledger, with_customer, "products", found="product_found", values={"active": "product_active"})


def order_book(ledger: Ledger) -> DataFrame:
    """One row: orders, orders_without_customer, bad_orders, orphan_payments.

    An order is bad when its total is missing, its customer is unknown, or it is completed and
    unpaid. Only the customer needs a second join, and that one meets orders already combined
    per customer id: every order of an unknown customer is bad, else those bad by themselves.
    """
    own_fault = F.col("order_found") & (
        F.col("total_amount").isNull() | ((F.col("status") == COMPLETED) & F.col("any_n").isNull()))
    per_customer = (paid_order_rows(ledger)
                    .select("customer_id", tally(F.col("order_found")).alias("orders"),
                            tally(own_fault).alias("own_fault"),
                            F.when(~F.col("order_found"), F.col("any_n")).alias("orphan_payments"))
                    .groupBy("customer_id")
                    .agg(*[F.sum(c).alias(c) for c in ("orders", "own_fault", "orphan_payments")]))
    known = key_set(ledger.customers, "customer_id", "_known")
    unknown = F.col("_known").isNull()
    none = F.lit(0).cast("long")
    return (per_customer.join(known, F.col("customer_id") == F.col("_known"), "left")
            .agg(*[F.coalesce(F.sum(value), none).alias(name) for name, value in {
                "orders": F.col("orders"),
                "orders_without_customer": F.when(unknown, F.col("orders")),
                "bad_orders": F.when(unknown, F.col("orders")).otherwise(F.col("own_fault")),
                "orphan_payments": F.col("orphan_payments")}.items()]))
