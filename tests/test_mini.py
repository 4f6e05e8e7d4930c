"""Exact results on the mini ledger, including report orders."""

from dataclasses import replace
from decimal import Decimal as D

import pytest
from fixture import day, mini_ledger, tuples

from ledgersift.operators.skew import NO_HOT_KEYS, SkewPolicy
from ledgersift.plans import checks, consolidated, feeds, report, scorecard
from ledgersift.plans.catalogue import CHECKS

POLICIES = {"plain": SkewPolicy(), "every_key_hot": SkewPolicy(rows_per_task=0.5),
            "few_hot": SkewPolicy(rows_per_task=1, max_hot_keys=2)}


@pytest.fixture(scope="module", params=[*POLICIES, "measured"])
def ledger(spark, request):
    if request.param == "measured":
        return mini_ledger(spark).measured()
    return mini_ledger(spark, skew=POLICIES[request.param])


def test_measured_ledger_needs_no_hot_keys(spark):
    small = mini_ledger(spark).measured()
    assert small.sizes == {"customers": 6, "products": 3, "orders": 9, "payments": 9}
    assert small.small("customers") and small.hot("payments", "order_id") == NO_HOT_KEYS
    large = mini_ledger(spark, skew=SkewPolicy(rows_per_task=5, broadcast_rows=2)).measured()
    assert not large.small("customers")
    assert tuples(large.hot("orders", "customer_id")) == []
    assert mini_ledger(spark).hot("orders", "customer_id") != NO_HOT_KEYS


def test_duplicate_groups(ledger):
    assert tuples(checks.duplicate_emails(ledger)) == [("a@x", 2, 1, day(1), day(3))]
    assert tuples(checks.duplicate_email_listing(ledger)) == [("a@x", 2, 1, "1, 3", day(1), day(3))]
    assert sorted(tuples(checks.duplicate_email_members(ledger))) == [("a@x", 1, "Ana"), ("a@x", 3, None)]
    assert tuples(checks.duplicate_email_rate(ledger)) == [(6, 2, 33.33)]


def test_orders_without_customer(ledger):
    found = CHECKS["orders_without_customer"].ordered(ledger)
    assert tuples(found, "order_id", "referenced_customer_id") == [(3, 99), (4, None)]
    assert tuples(checks.orders_without_customer_rate(ledger)) == [(9, 2, 22.22)]


def test_completed_without_payment(ledger):
    found = CHECKS["completed_without_payment"].ordered(ledger)
    assert tuples(found, "order_id", "customer_name", "total_amount") == [(6, "Bo", D("400.00")), (5, "Ana", None)]
    assert tuples(checks.completed_without_payment_risk(ledger)) == [(2, D("400.00"), D("400.00"))]


def test_orphan_payments(ledger):
    found = CHECKS["orphan_payments"].ordered(ledger)
    assert tuples(found, "payment_id", "referenced_order_id", "payment_amount") == [
        (5, 500, D("70.00")), (6, None, D("30.00"))]
    assert tuples(checks.orphan_payment_amount(ledger)) == [(2, D("100.00"))]
    assert sorted(tuples(checks.orphan_payments_by_status(ledger))) == [
        ("Paid", 1, D("70.00")), ("Pending", 1, D("30.00"))]


def test_amount_mismatch(ledger):
    found = CHECKS["amount_mismatches"].ordered(ledger)
    assert tuples(found, "order_id", "paid_amount", "diff", "diff_type", "diff_pct") == [
        (2, D("50.00"), D("-150.00"), "Underpaid", 75.0), (2, D("150.00"), D("-50.00"), "Underpaid", 25.0),
        (7, D("5.00"), D("5.00"), "Overpaid", None), (9, D("95.00"), D("5.00"), "Overpaid", 5.56)]
    assert tuples(checks.amount_mismatch_summary(ledger)) == [(4, D("210.00"), D("10.00"), D("200.00"))]


def test_revenue_at_risk(ledger):
    rows = tuples(CHECKS["revenue_at_risk"].ordered(ledger))
    assert rows == [("Completed orders without payment", 2, D("400.00")), ("Underpaid orders", 2, D("200.00")),
                    ("Orphan payments", 2, D("100.00")), ("Overpaid orders", 2, D("10.00"))]


def test_quality_score(ledger):
    rows = tuples(CHECKS["quality_score"].ordered(ledger))
    assert rows == [("customers", 6, 3, 50.0, 50.0), ("orders", 9, 4, 44.44, 55.56), ("payments", 9, 2, 22.22, 77.78)]
    scores = scorecard.quality_score(ledger)
    assert tuples(scorecard.global_score(scores)) == [(61.11, 62.5)]
    assert tuples(feeds.percent_with_problems(scores)) == [(37.5,)]


def test_nulls(ledger):
    assert sorted(tuples(checks.customers_with_nulls(ledger), "customer_id", "null_fields")) == [
        (3, "Name missing"), (4, "Name and email missing"), (5, "Email missing")]
    assert tuples(checks.orders_with_null_total(ledger)) == [(5, 1, day(5), "Completed", "total_amount is NULL")]
    assert tuples(CHECKS["null_census"].ordered(ledger)) == [
        ("customers.email", 2), ("customers.name", 2), ("orders.total_amount", 1), ("payments.payment_amount", 1),
        ("orders.order_date", 0)]


def test_inactive_products(ledger):
    found = CHECKS["inactive_product_orders"].ordered(ledger)
    assert tuples(found, "order_id", "total_amount", "product_name", "active") == [
        (6, D("400.00"), "P2", False), (2, D("200.00"), "P2", False)]
    assert tuples(checks.inactive_product_summary(ledger)) == [(2, D("600.00"))]


def test_consolidated_view(ledger):
    rows = tuples(CHECKS["consolidated_view"].ordered(ledger), "order_id", "paid_amount", *consolidated.FLAGS, "diff")
    zero = D("0.00")
    assert rows == [
        (1, D("100.00"), 0, 0, 0, 0, 0, zero),
        (2, D("50.00"), 0, 0, 1, 0, 1, D("-150.00")), (2, D("150.00"), 0, 0, 1, 0, 1, D("-50.00")),
        (3, zero, 1, 0, 0, 0, 0, None), (4, zero, 1, 0, 0, 0, 0, None),
        (5, zero, 0, 1, 0, 1, 0, None), (6, zero, 0, 1, 0, 0, 1, None),
        (7, D("5.00"), 0, 0, 1, 0, 0, D("5.00")), (8, zero, 0, 0, 0, 0, 0, None),
        (9, D("95.00"), 0, 0, 1, 0, 0, D("5.00"))]


def test_order_flags_count_each_order_once(ledger):
    rows = sorted(tuples(consolidated.order_flags(ledger), "order_id", *consolidated.FLAGS))
    assert rows == [(1, 0, 0, 0, 0, 0), (2, 0, 0, 1, 0, 1), (3, 1, 0, 0, 0, 0), (4, 1, 0, 0, 0, 0),
                    (5, 0, 1, 0, 1, 0), (6, 0, 1, 0, 0, 1), (7, 0, 0, 1, 0, 0), (8, 0, 0, 0, 0, 0),
                    (9, 0, 0, 1, 0, 0)]


def test_kpis_and_reconciliation(ledger):
    assert tuples(scorecard.ledger_kpis(ledger)) == [(6, 3, 9, 9, D("1090.00"))]
    assert sorted(tuples(checks.reconciliation(ledger), "order_id", "n_payments", "paid_total", "diff")) == [
        (3, 0, D("0.00"), D("-300.00")), (6, 0, D("0.00"), D("-400.00")),
        (7, 1, D("5.00"), D("5.00")), (9, 1, D("95.00"), D("5.00"))]


def test_report_agrees_with_the_single_checks(ledger):
    lines = {(r["section"], r["metric"]): r["value_text"] for r in report.sectioned_report(ledger).collect()}
    assert len(lines) == 46
    assert lines[(1, "gross revenue")] == "$ 1,090 COP"
    assert lines[(2, "affected pct")] == "33.33%"
    assert lines[(3, "without customer")] == "2"
    assert lines[(6, "underpaid")] == "$ 200 COP"
    assert lines[(9, "global")] == "61.11%"
    assert lines[(9, "orders with problems")] == "4" and lines[(9, "orders with problems pct")] == "44.44%"
    assert lines[(9, "payments records")] == "9"
    assert lines[(10, "Underpaid orders: records")] == "2"
    assert lines[(10, "total")] == "$ 710 COP"


def test_report_counts_payments_once_under_repeated_order_ids(spark):
    once = mini_ledger(spark)
    twice = replace(once, orders=once.orders.union(once.orders))
    lines = {(r["section"], r["metric"]): r["value_text"] for r in report.sectioned_report(twice).collect()}
    assert lines[(1, "payments")] == "9"
    scores = {name: total for name, total in tuples(scorecard.quality_score(twice), "table_name", "total")}
    assert {t: lines[(9, f"{t} records")] for t in scores} == {t: str(n) for t, n in scores.items()}


def test_global_score_raises_an_alert(ledger):
    scores = scorecard.quality_score(ledger)
    assert {t for (t,) in tuples(feeds.score_alerts(scores), "table_name")} == {
        "customers", "orders", "payments", "global"}
    assert {t for (t,) in tuples(feeds.score_alerts(scores, 60.0), "table_name")} == {"customers", "orders"}


def test_problem_slicer_and_over_under(ledger):
    problems = sorted(tuples(consolidated.problem_rows(ledger)))
    assert problems == [(2, "amount_mismatch"), (2, "amount_mismatch"), (2, "inactive_product"),
                        (2, "inactive_product"), (3, "no_customer"), (4, "no_customer"), (5, "no_payment"),
                        (5, "null_total"), (6, "inactive_product"), (6, "no_payment"), (7, "amount_mismatch"),
                        (9, "amount_mismatch")]
    assert sorted(tuples(consolidated.problem_rows(ledger, ["null_total"]))) == [(5, "null_total")]
    assert sorted(tuples(feeds.over_under_by_order(ledger))) == [
        (2, D("0.00"), D("200.00")), (7, D("5.00"), D("0.00")), (9, D("5.00"), D("0.00"))]
