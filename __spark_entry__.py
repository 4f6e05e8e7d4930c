
from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgersift.model import ORDER_STATUSES, PAYMENT_STATUSES, ROLE_SCHEMAS, Ledger  # noqa: E402
from ledgersift.operators import amounts, controls, duplicates, nulls, references, rules  # noqa: E402
from ledgersift.operators.facts import count_hot_keys, order_facts  # noqa: E402
from ledgersift.operators.skew import NO_HOT_KEYS  # noqa: E402
from ledgersift.plans import checks, consolidated, feeds, follow_up, history, impact, report, scorecard, trend  # noqa: E402
from ledgersift.session import shared_dir  # noqa: E402
from ledgersift.sinks.runner import run_all  # noqa: E402
from ledgersift.sinks.verified import verify  # noqa: E402
from ledgersift.sources.binding import (  # noqa: E402
    bound_customers,
    bound_ledger,
    bound_orders,
    bound_payments,
    table,
    table_stream,
)
from ledgersift.sources.layout import laid_out, lay_out  # noqa: E402
from ledgersift.streaming.daily import any_arrival, scorecard_job  # noqa: E402
from ledgersift.streaming.gate import pass_in_time, passed  # noqa: E402
from ledgersift.streaming.incremental import (  # noqa: E402
    current_scorecard,
    incremental_scorecard,
    ledger_arrivals,
)
from ledgersift.streaming.reconciled import absences, append_rows, closed_orders  # noqa: E402
from ledgersift.streaming.unmatched import unpaid_orders, write_unpaid  # noqa: E402
from oracle_queries import oracles  # noqa: E402

try:
    from ledgersift.llm.queries import QUERIES as LLM_QUERIES  # noqa: E402
    from ledgersift.llm.queries import SQL as LLM_SQL  # noqa: E402
except ModuleNotFoundError as missing:
    if missing.name != "ledgersift.llm":
        raise
    LLM_QUERIES, LLM_SQL = {}, {}
try:
    import corpus_pipeline  # noqa: E402
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "ledgersift.llm"):
        raise
    corpus_pipeline = None

Query = Callable[[SparkSession, str], DataFrame]

FIX_COST = Decimal("4000000")
AUDIT_DAY = date(2024, 1, 15)


def entry(spark: SparkSession) -> DataFrame:
    """The quality scorecard of the bound ledger."""
    return scorecard.quality_score(bound_ledger(spark, "/root/testdata/sf0.001"))


def _on(plan: Callable[[Ledger], DataFrame]) -> Query:
    """A query over the bound ledger."""
    return lambda spark, sf_dir: plan(bound_ledger(spark, sf_dir))


def _on_counted(plan: Callable[[Ledger], DataFrame]) -> Query:
    """A query over the bound ledger with its hot keys counted once, before the plan is made."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(count_hot_keys(bound_ledger(spark, sf_dir), _run_folder(spark, "hot")))
    return run


def _on_layout(plan: Callable[[Ledger], DataFrame]) -> Query:
    """A query over the bound ledger after its orders and payments were laid out for their join."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ledger, name = bound_ledger(spark, sf_dir), f"laid_out_{uuid.uuid4().hex}"
        return plan(laid_out(ledger, lay_out(ledger, name, f"{shared_dir(spark)}/{name}", buckets=8)))
    return run


def _on_scores(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return _on(lambda ledger: plan(scorecard.quality_score(ledger)))


def _on_risk(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return _on(lambda ledger: plan(scorecard.revenue_at_risk(ledger)))


def _email_names_report(ledger: Ledger) -> DataFrame:
    return duplicates.listing_blocks(ledger.customers, "email", "customer_id", "name", separator=" | ",
                                     policy=ledger.skew).select("email", "n", "names")


def order_rules() -> dict[str, object]:
    """Defects that keep an order out of the clean set, over ``order_facts`` columns."""
    return {"completed_without_payment": F.col("unpaid"),
            "inactive_product": F.col("product_active") == F.lit(False),
            "unknown_customer": ~F.col("customer_found"),
            "null_total": F.col("total_amount").isNull()}


def _quarantine(ledger: Ledger) -> DataFrame:
    _, bad = controls.split_valid(order_facts(ledger), order_rules())
    return bad.select("order_id", "customer_id", "status", "total_amount",
                      F.concat_ws(", ", "broken_rules").alias("broken"))


def _clean(ledger: Ledger) -> DataFrame:
    clean, _ = controls.split_valid(order_facts(ledger), order_rules())
    return clean.select("order_id", "customer_id", "status", "total_amount")


# The rules of the scorecard by rows: what the audit checks, and more tables and rules beside it.
_RULES = [
    ("customer has a name", "customers", rules.NOT_NULL, "name", None, None, None, None),
    ("email is unique", "customers", rules.UNIQUE, "email", None, None, None, None),
    ("price is positive", "products", rules.CONDITION, None, None, None, "price > 0", None),
    ("product state is known", "products", rules.NOT_NULL, "active", None, None, None, None),
    ("product was sold", "products", rules.HAS_CHILD, "product_id", "orders", "product_id", None, None),
    ("order has a total", "orders", rules.NOT_NULL, "total_amount", None, None, None, None),
    ("order has a customer", "orders", rules.REFERENCES, "customer_id", "customers", "customer_id", None, None),
    ("order status is known", "orders", rules.DOMAIN, "status", None, None, "|".join(ORDER_STATUSES), None),
    ("completed order has a payment", "orders", rules.HAS_CHILD, "order_id", "payments", "order_id", None,
     "status = 'Completed'"),
    ("order in progress has a payment", "orders", rules.HAS_CHILD, "order_id", "payments", "order_id", None,
     "status = 'Processing'"),
    ("ordered product exists", "orders", rules.FOREIGN_KEY, "product_id", "products", "product_id", None, None),
    ("payment has an order", "payments", rules.REFERENCES, "order_id", "orders", "order_id", None, None),
    ("payment status is known", "payments", rules.DOMAIN, "payment_status", None, None, "|".join(PAYMENT_STATUSES),
     None),
    ("confirmed payment is of 1000 at least", "payments", rules.CONDITION, None, None, None, "payment_amount >= 1000",
     "payment_status = 'Paid'"),
    ("line has a supplier", "lineitem", rules.REFERENCES, "l_suppkey", "supplier", "s_suppkey", None, None),
    ("line's product was ordered", "lineitem", rules.HAS_CHILD, "l_partkey", "orders", "product_id", None,
     "l_quantity > 10"),
    ("line is unique", "lineitem", rules.UNIQUE, "l_orderkey", None, None, None, "l_discount > 0.08"),
]


def _on_rules(plan: Callable[..., DataFrame], *more: str) -> Query:
    """A query over the bound ledger and two of the given tables, under rules read from a table."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ledger = bound_ledger(spark, sf_dir)
        sources = {"customers": rules.Source(ledger.customers, ("customer_id",)),
                   "products": rules.Source(ledger.products, ("product_id",)),
                   "orders": rules.Source(ledger.orders, ("order_id",)),
                   "payments": rules.Source(ledger.payments, ("payment_id",)),
                   "lineitem": rules.Source(table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber")),
                   "supplier": rules.Source(table(spark, sf_dir, "supplier"), ("s_suppkey",))}
        return plan(sources, spark.createDataFrame(_RULES, rules.RULE_SCHEMA), *more, policy=ledger.skew)
    return run


def _order_violations(*args, **options) -> DataFrame:
    return rules.rule_violations(*args, **options).select("order_id", "status",
                                                          F.concat_ws(", ", "broken_rules").alias("broken"))


def _run_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _export_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = bound_ledger(spark, sf_dir)
    done = run_all(spark, ledger, _run_folder(spark, "exports"), day=AUDIT_DAY, share=True)
    return done.select("name", "rows", "status")


def _export_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ten files of a run hold, read back from them."""
    folder = _run_folder(spark, "exports")
    run_all(spark, bound_ledger(spark, sf_dir), folder, day=AUDIT_DAY, share=True)
    return verify(spark, folder, AUDIT_DAY)


def _daily_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the incremental job over the files of all tables and reads back what it wrote."""
    folder = _run_folder(spark, "scorecard")
    arrivals = any_arrival(*[table_stream(spark, sf_dir, t) for t in ("customer", "part", "orders", "lineitem")])
    scorecard_job(arrivals, lambda: bound_ledger(spark, sf_dir), f"{folder}/out", f"{folder}/state",
                  AUDIT_DAY.isoformat()).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _stream_unpaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed orders whose 30 days passed without payment, from both tables as streams."""
    folder = _run_folder(spark, "unpaid")
    orders = bound_orders(table_stream(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))
    payments = bound_payments(table_stream(spark, sf_dir, "orders"))
    write_unpaid(unpaid_orders(orders, payments), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _bound_streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders and payments of the bound ledger as streams."""
    return (bound_orders(table_stream(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")),
            bound_payments(table_stream(spark, sf_dir, "orders")))


def _incremental_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorecard kept by key, after the files of all tables have arrived."""
    folder = _run_folder(spark, "incremental")
    customers = bound_customers(table_stream(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"))
    arrivals = ledger_arrivals(customers, *_bound_streams(spark, sf_dir))
    incremental_scorecard(arrivals, folder, buckets=16).awaitTermination()
    return current_scorecard(spark, folder)


def _stream_absences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without payment and payments without order, from both tables as streams."""
    folder = _run_folder(spark, "absences")
    append_rows(absences(*_bound_streams(spark, sf_dir)), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _stream_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders closed 30 days after their day, held against their confirmed payments; late rows are set aside before."""
    folder = _run_folder(spark, "reconciled")
    streams = dict(zip(("orders", "payments"), _bound_streams(spark, sf_dir), strict=True))
    times = {"orders": "order_date", "payments": "payment_date"}
    pass_in_time({role: (stream, times[role]) for role, stream in streams.items()}, f"{folder}/gate",
                 lateness=timedelta(days=1)).awaitTermination()
    in_time = [passed(spark, f"{folder}/gate", role, ROLE_SCHEMAS[role].simpleString()[7:-1].replace(":", " "))
               for role in streams]
    append_rows(closed_orders(*in_time), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _score_change(ledger: Ledger) -> DataFrame:
    return history.score_change(scorecard.quality_score(history.as_of(ledger, "1998-07-01 00:00:00")),
                                scorecard.quality_score(ledger))


def _trend_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend kept by day: the ledger as of a moment, then what arrived after it, on the days it touches."""
    moment = "1998-07-01 00:00:00"
    ledger, folder = bound_ledger(spark, sf_dir), _run_folder(spark, "trend")

    def since(df: DataFrame, column: str) -> DataFrame:
        return df.where(F.col(column) >= F.lit(moment).cast("timestamp_ntz"))

    trend.write_days(history.as_of(ledger, moment), folder)
    days = trend.touched_days(ledger, customers=since(ledger.customers, "created_at"),
                              orders=since(ledger.orders, "order_date"), payments=since(ledger.payments, "payment_date"))
    trend.refresh_days(ledger, folder, days)
    return trend.trend(spark, folder)


def _follow_up(ledger: Ledger) -> DataFrame:
    return follow_up.follow_up(follow_up.defects(history.as_of(ledger, "1998-07-01 00:00:00")), follow_up.defects(ledger))


def _keyed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts compared through their digest, so that texts are not shuffled."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_key"))


def _document_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_groups(_keyed_documents(spark, sf_dir), "text_key")


def _document_duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_members(_keyed_documents(spark, sf_dir), "text_key", "doc_id")


def _documents_without_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return references.orphans(documents, table(spark, sf_dir, "labels"), "doc_id", "doc_id", reason="no label",
                              hot=NO_HOT_KEYS)


def _orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    alone = references.missing_children(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"),
                                        "o_orderkey", "l_orderkey")
    return alone.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def _order_line_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("order_total"))
    value = F.expr("CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) "
                   "AS DECIMAL(18,2))")
    return (amounts.reconcile(orders, table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey",
                              "order_total", value)
            .withColumnsRenamed({"n_children": "n_lines", "actual_total": "lines_total"}))


def queries() -> dict[str, Query]:
    """Every implemented operator, by SURVEY id, then those for training text."""
    return _audit_queries() | LLM_QUERIES | ({"pipeline": corpus_pipeline.run} if corpus_pipeline else {})


def _audit_queries() -> dict[str, Query]:
    return {
        "a01_duplicate_groups": _on(checks.duplicate_emails),
        "a01_duplicate_blocks": _on(lambda ledger: duplicates.listing_blocks(
            ledger.customers, "email", "customer_id", "name", policy=ledger.skew)),
        "a01_duplicate_groups_export": _on(checks.duplicate_email_listing),
        "a01_duplicate_members": _on(checks.duplicate_email_members),
        "a01_duplicate_names_report": _on(_email_names_report),
        "a02_duplicate_rate": _on(checks.duplicate_email_rate),
        "a03_orders_without_customer": _on(checks.orders_without_customer),
        "a04_orders_without_customer_rate": _on(checks.orders_without_customer_rate),
        "a05_completed_without_payment": _on(checks.completed_without_payment),
        "a05_laid_out": _on_layout(checks.completed_without_payment),
        "a06_completed_without_payment_risk": _on(checks.completed_without_payment_risk),
        "a07_orphan_payments": _on(checks.orphan_payments),
        "a07_laid_out": _on_layout(checks.orphan_payments),
        "a08_orphan_payment_amount": _on(checks.orphan_payment_amount),
        "a09_amount_mismatch": _on_counted(checks.amount_mismatches),
        "a09_laid_out": _on_layout(checks.amount_mismatches),
        "a10_amount_mismatch_summary": _on(checks.amount_mismatch_summary),
        "a11_revenue_at_risk": _on(scorecard.revenue_at_risk),
        "a12_quality_score": _on(scorecard.quality_score),
        "a12_quality_score_rules": _on_rules(rules.quality_score),
        "a12_rule_counts": _on_rules(rules.rule_counts),
        "a12_rule_violations": _on_rules(_order_violations, "orders"),
        "a13_customers_with_nulls": _on(checks.customers_with_nulls),
        "a14_orders_with_null_total": _on(checks.orders_with_null_total),
        "a15_null_census": _on(checks.null_census),
        "a15_null_census_export": _on(lambda ledger: checks.null_census(ledger, full=False)),
        "a16_inactive_product_orders": _on_counted(checks.inactive_product_orders),
        "a17_inactive_product_summary": _on(checks.inactive_product_summary),
        "a18_consolidated_view": _on_counted(consolidated.consolidated_view),
        "a18_laid_out": _on_layout(consolidated.consolidated_view),
        "a19_ledger_kpis": _on(scorecard.ledger_kpis),
        "a20_global_score": _on_scores(scorecard.global_score),
        "a21_reconciliation": _on(checks.reconciliation),
        "b01_revenue_at_risk_total": _on_risk(scorecard.revenue_at_risk_total),
        "b02_quality_score_global": _on_scores(lambda s: scorecard.global_score(s).select("mean_score")),
        "b03_percent_with_problems": _on_scores(feeds.percent_with_problems),
        "b04_kpi_cards": _on(lambda ledger: feeds.kpi_cards(scorecard.quality_score(ledger),
                                                            scorecard.revenue_at_risk(ledger))),
        "b05_risk_by_category": _on_risk(lambda risk: risk.select("category", "amount")),
        "b06_problem_rows": _on_counted(consolidated.problem_rows),
        "b07_error_distribution": _on_scores(feeds.error_distribution),
        "b08_over_under_by_order": _on(feeds.over_under_by_order),
        "b09_error_trend": _on_counted(consolidated.error_trend),
        "b09_trend_by_day": _trend_by_day,
        "b10_order_vs_paid": _on(consolidated.order_vs_paid),
        "b11_score_vs_target": _on_scores(feeds.score_vs_target),
        "b12_score_alerts": _on_scores(feeds.score_alerts),
        "c01_risk_shares": _on_risk(impact.risk_shares),
        "c02_annual_projection": _on_risk(impact.annual_projection),
        "c03_growth_projection": _on_risk(impact.growth_projection),
        "c04_fix_roi": _on_risk(lambda risk: impact.fix_roi(risk, FIX_COST)),
        "c05_orphan_payments_by_status": _on(checks.orphan_payments_by_status),
        "d04_export_gate": _export_gate,
        "d04_export_run": _export_run,
        "d06_full_report": _on(lambda ledger: report.full_report(ledger, datetime(2024, 1, 15, 6, 30))),
        "d06_sectioned_report": _on(report.sectioned_report),
        "f01_unique_email": _on(lambda ledger: duplicates.check_unique(ledger.customers, ["email"])),
        "f01_unique_line_key": lambda spark, sf_dir: duplicates.check_unique(
            table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]),
        "f02_fk_orders_customers": _on(lambda ledger: controls.check_fk(
            ledger.orders.select("order_id", "customer_id"), ledger.customers, "customer_id", "customer_id",
            spread_by=["order_id"], policy=ledger.skew)),
        "f02_fk_payments_orders": _on(lambda ledger: controls.check_fk(
            ledger.payments.select("payment_id", "order_id"), ledger.orders, "order_id", "order_id",
            spread_by=["payment_id"], policy=ledger.skew)),
        "f03_not_null_customers": _on(lambda ledger: nulls.check_not_null(ledger.customers, ["name"])
                                      .select("customer_id", F.concat_ws(", ", "violations").alias("violations"))),
        "f03_not_null_orders": _on(lambda ledger: nulls.check_not_null(ledger.orders, ["total_amount"])
                                   .select("order_id", F.concat_ws(", ", "violations").alias("violations"))),
        "f04_status_domain": _on(lambda ledger: controls.check_domain(
            ledger.orders.select("order_id", "status"), "status", ORDER_STATUSES)),
        "f04_payment_status_domain": _on(lambda ledger: controls.check_domain(
            ledger.payments.select("payment_id", "payment_status"), "payment_status", PAYMENT_STATUSES)),
        "f05_quarantine": _on_counted(_quarantine),
        "f06_clean": _on_counted(_clean),
        "f07_stream_reconciliation": _stream_reconciliation,
        "f08_daily_scorecard": _daily_scorecard,
        "f08_incremental_scorecard": _incremental_scorecard,
        "f09_follow_up": _on(_follow_up),
        "f09_follow_up_summary": _on(lambda ledger: follow_up.follow_up_summary(_follow_up(ledger))),
        "f09_score_change": _on(_score_change),
        "f10_stream_absences": _stream_absences,
        "f10_stream_unpaid": _stream_unpaid,
        "n01_document_duplicates": _document_duplicates,
        "n01_document_duplicate_members": _document_duplicate_members,
        "n03_documents_without_labels": _documents_without_labels,
        "n05_orders_without_lines": _orders_without_lines,
        "n21_order_line_reconciliation": _order_line_reconciliation,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for every registered query that SQL can express."""
    extra = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline and corpus_pipeline.ORACLE_SQL else {}
    return oracles() | LLM_SQL | extra
