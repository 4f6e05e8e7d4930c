"""Quality score per table, the two global scores, ledger KPIs and the risk roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.functions.expressions import MONEY_SUM, money, percent, ratio, rows, score
from ledgersift.model import COMPLETED, Ledger
from ledgersift.operators.facts import identity_facts, order_book, settlement_totals


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0).cast("long"))


def table_counts(ledger: Ledger) -> DataFrame:
    """table_name, total, bad for customers, orders and payments; a row counts once however many
    rules it breaks.
    """
    identity = identity_facts(ledger).agg(_zero(F.sum("n")).alias("total"), _zero(F.sum("bad")).alias("bad"))
    # Payments are counted on their own, so a repeated order id cannot count one twice.
    counted = ledger.payments.agg(rows().alias("payments"))
    both = (order_book(ledger).unionByName(counted, allowMissingColumns=True)
            .agg(*[F.max(c).alias(c) for c in ("orders", "bad_orders", "payments", "orphan_payments")]))
    pairs = F.array(
        F.struct(F.lit("orders").alias("table_name"), F.col("orders").alias("total"),
                 F.col("bad_orders").alias("bad")),
        F.struct(F.lit("payments").alias("table_name"), F.col("payments").alias("total"),
                 F.col("orphan_payments").alias("bad")))
    return (identity.select(F.lit("customers").alias("table_name"), "total", "bad")
            .unionByName(both.select(F.inline(pairs))))


def quality_score(ledger: Ledger) -> DataFrame:
    """table_name, total, bad, pct, score; an empty table has NULL pct and score."""
    return scored(table_counts(ledger))


def scored(counts: DataFrame) -> DataFrame:
    return counts.select("table_name", "total", "bad", percent(F.col("bad"), F.col("total")).alias("pct"),
                         score(F.col("bad"), F.col("total")).alias("score"))


def global_score(scores: DataFrame) -> DataFrame:
    """mean_score: plain mean of the rounded table scores, an empty table counting as 100.
    weighted_score: 100 - 100 * bad / total over all rows, 100 when there are none."""
    weighted = F.lit(100) - F.coalesce(ratio(F.sum("bad"), F.sum("total")), F.lit(0))
    return scores.agg(mean_score().alias("mean_score"), F.round(weighted, 2).cast("double").alias("weighted_score"))


def mean_score() -> Column:
    """Aggregate over a scorecard: the mean of the table scores, an empty table counting as 100."""
    mean = F.avg(F.coalesce(F.col("score"), F.lit(100.0)).cast("decimal(10,2)"))
    return F.round(F.coalesce(mean, F.lit(100)), 2).cast("double")


def revenue_at_risk(ledger: Ledger) -> DataFrame:
    """category, n, amount for the four kinds of risk, always four rows.

    The unpaid amount is 0 when there is none; the other three are NULL.
    """
    return risk_rows(settlement_totals(ledger), ledger)


def risk_rows(totals: DataFrame, ledger: Ledger) -> DataFrame:
    words = ledger.labels
    unpaid = F.coalesce(money(F.col("unpaid_amount")), F.lit(0).cast(MONEY_SUM))
    lines = [(words.risk_unpaid, "unpaid", unpaid),
             (words.risk_underpaid, "under", money(F.col("under_amount"))),
             (words.risk_overpaid, "over", money(F.col("over_amount"))),
             (words.risk_orphan, "orphan_payments", money(F.col("orphan_amount")))]
    cells = F.array(*[F.struct(F.lit(label).alias("category"), _zero(F.col(n)).alias("n"), amount.alias("amount"))
                      for label, n, amount in lines])
    return totals.select(F.inline(cells))


def revenue_at_risk_total(risk: DataFrame) -> DataFrame:
    """n and amount over the roll-up, a NULL amount counting as 0."""
    return risk.agg(_zero(F.sum("n")).alias("n"),
                    F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY_SUM).alias("amount"))


def ledger_kpis(ledger: Ledger) -> DataFrame:
    """customers, products, orders, payments, gross_revenue (completed orders) in one row.

    Each table gives one row of counts; the four rows are summed into one.
    """
    gross = F.sum(F.when(F.col("status") == COMPLETED, F.col("total_amount")))
    parts = [ledger.customers.agg(rows().alias("customers")),
             ledger.products.agg(rows().alias("products")),
             ledger.orders.agg(rows().alias("orders"), money(gross).alias("gross_revenue")),
             ledger.payments.agg(rows().alias("payments"))]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.sum(c).alias(c) for c in ("customers", "products", "orders", "payments")],
                       F.coalesce(money(F.sum("gross_revenue")), F.lit(0).cast(MONEY_SUM)).alias("gross_revenue"))
