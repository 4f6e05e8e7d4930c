"""Relations between checks that must hold on any ledger, on random ledgers with hot keys."""

import random
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from fixture import ledger_of, tuples
from pyspark.sql import functions as F

from ledgersift.operators.skew import SkewPolicy
from ledgersift.plans import checks, consolidated, report, scorecard

START = datetime(2024, 1, 1)


def random_rows(seed):
    rng = random.Random(seed)

    def maybe(value, p=0.1):
        return None if rng.random() < p else value

    def when():
        return maybe(START + timedelta(days=rng.randrange(40)), 0.05)

    def money(high):
        return maybe(D(rng.randrange(high)) / 2)

    customers = [(i, maybe(f"n{i}"), maybe("hot@x" if rng.random() < .3 else f"e{rng.randrange(40)}"), when())
                 for i in range(60)]
    products = [(i, f"p{i}", D(i + 1), maybe(rng.random() < .6)) for i in range(12)]
    orders = [(i, maybe(3 if rng.random() < .3 else rng.randrange(90)), maybe(rng.randrange(16)), when(),
               maybe(rng.choice(["Pending", "Processing", "Completed", "Completed", "Cancelled"]), .05), money(8))
              for i in range(150)]
    payments = [(i, maybe(5 if rng.random() < .3 else rng.randrange(200)), when(), money(8),
                 maybe(rng.choice(["Paid", "Paid", "Failed", "Pending"]), .05)) for i in range(260)]
    return dict(customers=customers, products=products, orders=orders, payments=payments)


@pytest.fixture(scope="module", params=[(1, SkewPolicy()), (2, SkewPolicy(rows_per_task=10)),
                                        (3, SkewPolicy(rows_per_task=1, max_hot_keys=5))],
                ids=["plain", "split", "few_hot"])
def case(spark, request):
    seed, policy = request.param
    rows = random_rows(seed)
    return rows, ledger_of(spark, **rows, skew=policy)


def test_against_brute_force(case):
    rows, ledger = case
    known = {c[0] for c in rows["customers"]}
    order_ids = {o[0] for o in rows["orders"]}
    paid_ids = {p[1] for p in rows["payments"]}
    emails = Counter(c[2] for c in rows["customers"] if c[2] is not None)
    no_customer = {o[0] for o in rows["orders"] if o[1] not in known}
    unpaid = {o[0] for o in rows["orders"] if o[4] == "Completed" and o[0] not in paid_ids}
    orphans = {p[0] for p in rows["payments"] if p[1] not in order_ids}
    bad = {o[0] for o in rows["orders"] if o[5] is None} | no_customer | unpaid
    bad_customers = [c for c in rows["customers"] if c[1] is None or emails[c[2]] > 1]
    totals = {o[0]: o[5] for o in rows["orders"]}
    diffs = Counter()
    for _, order, _, amount, status in rows["payments"]:
        total = totals.get(order)
        if status == "Paid" and amount is not None and total is not None and amount != total:
            diffs[(order, amount - total)] += 1

    assert {i for (i,) in tuples(checks.orders_without_customer(ledger), "order_id")} == no_customer
    assert {i for (i,) in tuples(checks.completed_without_payment(ledger), "order_id")} == unpaid
    assert {i for (i,) in tuples(checks.orphan_payments(ledger), "payment_id")} == orphans
    assert Counter(tuples(checks.amount_mismatches(ledger), "order_id", "diff")) == diffs
    assert {r[0]: r[2] for r in tuples(scorecard.quality_score(ledger))} == {
        "customers": len(bad_customers), "orders": len(bad), "payments": len(orphans)}


def test_summary_equals_aggregate_of_detail(case):
    _, ledger = case
    n, amount = tuples(checks.orphan_payment_amount(ledger))[0]
    assert (n, amount) == tuples(checks.orphan_payments(ledger).agg(F.count("*"), F.sum("payment_amount")))[0]
    n, total, over, under = tuples(checks.amount_mismatch_summary(ledger))[0]
    assert total == over + under
    assert (n, total) == tuples(checks.amount_mismatches(ledger).agg(F.count("*"), F.sum(F.abs("diff"))))[0]
    n, amount, _ = tuples(checks.completed_without_payment_risk(ledger))[0]
    assert (n, amount) == tuples(checks.completed_without_payment(ledger).agg(F.count("*"), F.sum("total_amount")))[0]
    assert tuples(checks.inactive_product_summary(ledger)) == tuples(
        checks.inactive_product_orders(ledger).agg(F.count("*"), F.sum("total_amount")))
    groups = checks.duplicate_emails(ledger)
    total, affected, _ = tuples(checks.duplicate_email_rate(ledger))[0]
    sizes = dict(tuples(groups, "email", "n"))
    assert affected == sum(sizes.values()) >= 2 * len(sizes)
    members = tuples(checks.duplicate_email_members(ledger), "email", "customer_id")
    assert Counter(email for email, _ in members) == sizes and len(set(members)) == len(members)


def test_one_pass_totals_equal_the_single_checks(case):
    _, ledger = case
    got = report.audit_totals(ledger).collect()[0].asDict()
    risk = {c: (n, a) for c, n, a in tuples(scorecard.revenue_at_risk(ledger))}
    assert (got["unpaid"], got["unpaid_amount"]) == risk["Completed orders without payment"]
    assert (got["under"], got["under_amount"]) == risk["Underpaid orders"]
    assert (got["over"], got["over_amount"]) == risk["Overpaid orders"]
    assert (got["orphan_payments"], got["orphan_amount"]) == risk["Orphan payments"]
    scores = {t: (n, b) for t, n, b in tuples(scorecard.quality_score(ledger), "table_name", "total", "bad")}
    assert (got["customers"], got["bad_customers"]) == scores["customers"]
    assert (got["orders"], got["bad_orders"]) == scores["orders"]
    assert (got["payments"], got["orphan_payments"]) == scores["payments"]
    assert (got["orders"], got["orders_without_customer"]) == tuples(
        checks.orders_without_customer_rate(ledger), "total", "orphans")[0]
    census = dict(tuples(checks.null_census(ledger)))
    assert [got[c] for c in ("name_null", "email_null", "total_null", "date_null", "payment_amount_null")] == [
        census[c] for c in ("customers.name", "customers.email", "orders.total_amount", "orders.order_date",
                            "payments.payment_amount")]


def test_view_flags_equal_the_details(case):
    _, ledger = case
    view = consolidated.consolidated_view(ledger).cache()
    per_order = view.groupBy("order_id").agg(*[F.max(f).alias(f) for f in consolidated.FLAGS])
    assert Counter(tuples(per_order, "order_id", *consolidated.FLAGS)) == Counter(
        tuples(consolidated.order_flags(ledger), "order_id", *consolidated.FLAGS))
    assert per_order.count() == ledger.orders.count()
    flagged = tuples(per_order.agg(*[F.sum(f) for f in consolidated.FLAGS]))[0]
    assert flagged[0] == checks.orders_without_customer(ledger).count()
    assert flagged[1] == checks.completed_without_payment(ledger).count()
    assert flagged[2] == checks.amount_mismatches(ledger).select("order_id").distinct().count()
    assert flagged[3] == checks.orders_with_null_total(ledger).count()
    assert flagged[4] == checks.inactive_product_orders(ledger).count()
    assert view.where("amount_mismatch = 1").count() == checks.amount_mismatches(ledger).count()
    view.unpersist()


def test_orphans_and_matches_partition_the_children(case):
    rows, ledger = case
    found = ledger.payments.join(ledger.orders.select("order_id"), "order_id", "left_semi").count()
    assert found + checks.orphan_payments(ledger).count() == len(rows["payments"])
