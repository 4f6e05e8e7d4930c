"""Every headline figure of the audit from one plan, and the sectioned report built on it."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.functions.expressions import MONEY_SUM, money, ratio, rows
from ledgersift.model import Ledger
from ledgersift.operators.duplicates import listing_blocks
from ledgersift.operators.facts import identity_facts, order_book, order_measures, settlement_totals
from ledgersift.plans.checks import inactive_product_summary

COUNTS = ("customers", "duplicate_customers", "bad_customers", "name_null", "email_null",
          "products", "orders", "orders_without_customer", "bad_orders", "total_null", "date_null",
          "payments", "payment_amount_null", "unpaid", "orphan_payments", "over", "under", "inactive_orders")
AMOUNTS = ("gross_amount", "unpaid_amount", "orphan_amount", "over_amount", "under_amount", "inactive_amount")


def audit_totals(ledger: Ledger) -> DataFrame:
    """One row with every count and amount the checks report.

    Seven one-row aggregates, summed into one row: customers by email; orders and payments joined
    twice, to payment totals for the order book and row by row for the amounts (the second join
    needs no grouping); orders alone; payments alone; the catalogue; orders per product. Amounts stay NULL where
    nothing qualified.
    """
    identity = identity_facts(ledger).agg(
        F.sum("n").alias("customers"),
        F.sum(F.when(F.col("shared"), F.col("n"))).alias("duplicate_customers"),
        F.sum("bad").alias("bad_customers"), F.sum("name_null").alias("name_null"),
        F.sum(F.when(F.col("email").isNull(), F.col("n"))).alias("email_null"))
    book = order_book(ledger).drop("orphan_payments")
    alone = ledger.orders.agg(*[F.sum(measure).alias(name) for name, measure in order_measures().items()])
    # Payments are counted on their own table: after the join, a repeated order id would count them twice.
    paid = ledger.payments.agg(rows().alias("payments"), F.count_if(F.col("payment_amount").isNull())
                               .alias("payment_amount_null"))
    catalogue = ledger.products.agg(rows().alias("products"))
    inactive = inactive_product_summary(ledger).select(
        F.col("n").alias("inactive_orders"), F.col("amount").alias("inactive_amount"))
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                   [identity, book, settlement_totals(ledger).drop("payments", "payment_amount_null"), alone, paid,
                    catalogue, inactive])
    return parts.agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in COUNTS],
                     *[money(F.max(c)).alias(c) for c in AMOUNTS])


def _number(value: Column) -> Column:
    return value.cast(MONEY_SUM)


def _line(section: int, title: str, metric: str, kind: str, value: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), F.lit(title).alias("title"), F.lit(metric).alias("metric"),
                    F.lit(kind).alias("kind"), _number(value).alias("value_num"))


def _percent(part: str, whole: str) -> Column:
    return F.coalesce(F.round(ratio(F.col(part), F.col(whole)), 2), F.lit(0))


def _score(bad: str, total: str) -> Column:
    return F.round(F.lit(100) - ratio(F.col(bad), F.col(total)), 2)


def sectioned_report(ledger: Ledger) -> DataFrame:
    """section, title, metric, kind, value_num, value_text: the ten-section report as rows.

    Money is shown with thousands separators, its currency and no decimals, percentages with two, and a
    missing value as N/A.
    """
    words = ledger.labels
    c = F.col
    zero = F.lit(0).cast(MONEY_SUM)
    bad_rows = [("customers", "bad_customers"), ("orders", "bad_orders"), ("payments", "orphan_payments")]
    table_scores = [_score(bad, table) for table, bad in bad_rows]
    mean = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(100)) for s in table_scores]) / F.lit(3)
    risks = [(words.risk_unpaid, "unpaid_amount", "unpaid"), (words.risk_underpaid, "under_amount", "under"),
             (words.risk_overpaid, "over_amount", "over"), (words.risk_orphan, "orphan_amount", "orphan_payments")]
    discrepancy = F.when(c("over_amount").isNull() & c("under_amount").isNull(), F.lit(None)).otherwise(
        F.coalesce("over_amount", zero) + F.coalesce("under_amount", zero))
    found = discrepancy.isNotNull()
    lines = [
        _line(1, "Ledger", "customers", "count", c("customers")),
        _line(1, "Ledger", "products", "count", c("products")),
        _line(1, "Ledger", "orders", "count", c("orders")),
        _line(1, "Ledger", "payments", "count", c("payments")),
        _line(1, "Ledger", "gross revenue", "money", F.coalesce("gross_amount", zero)),
        _line(2, "Duplicate emails", "customers", "count", c("customers")),
        _line(2, "Duplicate emails", "affected", "count", c("duplicate_customers")),
        _line(2, "Duplicate emails", "affected pct", "percent", F.round(ratio(c("duplicate_customers"),
                                                                             c("customers")), 2)),
        _line(3, "Referential integrity", "orders", "count", c("orders")),
        _line(3, "Referential integrity", "without customer", "count", c("orders_without_customer")),
        _line(3, "Referential integrity", "without customer pct", "percent",
              _percent("orders_without_customer", "orders")),
        _line(4, "Completed without payment", "orders", "count", c("unpaid")),
        _line(4, "Completed without payment", "revenue at risk", "money", F.coalesce("unpaid_amount", zero)),
        _line(5, "Orphan payments", "payments", "count", c("orphan_payments")),
        _line(5, "Orphan payments", "unreconciled", "money", F.coalesce("orphan_amount", zero)),
        _line(6, "Amount mismatch", "payments", "count", c("over") + c("under")),
        _line(6, "Amount mismatch", "total difference", "money", discrepancy),
        _line(6, "Amount mismatch", "overpaid", "money", F.when(found, F.coalesce("over_amount", zero))),
        _line(6, "Amount mismatch", "underpaid", "money", F.when(found, F.coalesce("under_amount", zero))),
        _line(7, "Missing critical fields", "customers.name", "count", c("name_null")),
        _line(7, "Missing critical fields", "customers.email", "count", c("email_null")),
        _line(7, "Missing critical fields", "orders.total_amount", "count", c("total_null")),
        _line(8, "Discontinued products", "orders", "count", c("inactive_orders")),
        _line(8, "Discontinued products", "amount", "money", F.coalesce("inactive_amount", zero)),
        _line(9, "Quality score", "customers", "percent", table_scores[0]),
        _line(9, "Quality score", "orders", "percent", table_scores[1]),
        _line(9, "Quality score", "payments", "percent", table_scores[2]),
        _line(9, "Quality score", "global", "percent", F.round(mean, 2)),
        *[line for table, bad in bad_rows for line in (
            _line(9, "Quality score", f"{table} records", "count", c(table)),
            _line(9, "Quality score", f"{table} with problems", "count", c(bad)),
            _line(9, "Quality score", f"{table} with problems pct", "percent", F.round(ratio(c(bad), c(table)), 2)))],
        *[_line(10, "Revenue at risk", label, "money", F.coalesce(column, zero)) for label, column, _ in risks],
        *[_line(10, "Revenue at risk", f"{label}: records", "count", c(number)) for label, _, number in risks],
        _line(10, "Revenue at risk", "total", "money",
              reduce(lambda a, b: a + b, [F.coalesce(column, zero) for _, column, _ in risks])),
    ]
    value = F.col("value_num")
    text = (F.when(value.isNull(), F.lit("N/A"))
            .when(F.col("kind") == "count", F.format_string("%d", value.cast("long")))
            .when(F.col("kind") == "percent", F.concat(value.cast("decimal(24,2)").cast("string"), F.lit("%")))
            .otherwise(F.concat(F.lit("$ "), F.format_number(F.round(value, 0), 0), F.lit(f" {words.currency}"))))
    return audit_totals(ledger).select(F.inline(F.array(*lines))).withColumn("value_text", text)


def full_report(ledger: Ledger, generated: datetime) -> DataFrame:
    """The whole report: its head (section 0: when it was made, what it covers, the first and last day of order), the
    figures of ``sectioned_report``, and a line for each shared email (its count and its customers' names; a very large group
    takes several lines).
    """
    def head(metric: str, text: Column) -> Column:
        return F.struct(F.lit(0).alias("section"), F.lit("Audit report").alias("title"), F.lit(metric).alias("metric"),
                        F.lit("text").alias("kind"), F.lit(None).cast(MONEY_SUM).alias("value_num"),
                        text.alias("value_text"))

    days = ledger.orders.agg(*[F.date_format(f("order_date"), "yyyy-MM-dd").alias(name)
                               for f, name in ((F.min, "first"), (F.max, "last"))])
    lines = days.select(F.inline(F.array(
        head("generated", F.lit(f"{generated:%Y-%m-%d %H:%M:%S}")),
        head("scope", F.lit("Customers, Products, Orders, Payments")),
        head("period from", F.coalesce("first", F.lit("N/A"))), head("period to", F.coalesce("last", F.lit("N/A"))))))
    shared = listing_blocks(ledger.customers, "email", "customer_id", "name", separator=" | ", policy=ledger.skew).select(
        F.lit(2).alias("section"), F.lit("Duplicate emails").alias("title"), F.col("email").alias("metric"),
        F.lit("detail").alias("kind"), _number(F.col("n")).alias("value_num"), F.col("names").alias("value_text"))
    return lines.unionByName(sectioned_report(ledger)).unionByName(shared)
