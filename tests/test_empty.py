"""Results when nothing qualifies: which are 0, which are NULL, which have no rows."""

from decimal import Decimal as D

import pytest
from fixture import day, ledger_of, tuples

from ledgersift.model import SchemaError, conform, empty_ledger
from ledgersift.plans import checks, consolidated, feeds, impact, report, scorecard
from ledgersift.plans.catalogue import CHECKS

ZERO = D("0.00")


@pytest.fixture(scope="module")
def nothing(spark):
    return empty_ledger(spark)


@pytest.mark.parametrize("name", [n for n, c in CHECKS.items() if not c.summary])
def test_details_are_empty(nothing, name):
    assert CHECKS[name].ordered(nothing).count() == 0


def test_rates(nothing):
    assert tuples(checks.duplicate_email_rate(nothing)) == [(0, None, None)]
    assert tuples(checks.orders_without_customer_rate(nothing)) == [(0, None, None)]


def test_amounts(nothing):
    assert tuples(checks.completed_without_payment_risk(nothing)) == [(0, ZERO, ZERO)]
    assert tuples(checks.inactive_product_summary(nothing)) == [(0, ZERO)]
    assert tuples(checks.orphan_payment_amount(nothing)) == [(0, None)]
    assert tuples(checks.orphan_payment_amount(nothing, coalesce_empty=True)) == [(0, ZERO)]
    assert tuples(checks.amount_mismatch_summary(nothing)) == [(0, None, None, None)]
    assert tuples(scorecard.ledger_kpis(nothing)) == [(0, 0, 0, 0, ZERO)]


def test_risk_has_four_rows_and_nulls_first(nothing):
    rows = tuples(CHECKS["revenue_at_risk"].ordered(nothing))
    assert [r[1] for r in rows] == [0, 0, 0, 0]
    assert [r[2] for r in rows] == [None, None, None, ZERO]
    risk = scorecard.revenue_at_risk(nothing)
    assert tuples(scorecard.revenue_at_risk_total(risk)) == [(0, ZERO)]
    assert tuples(impact.fix_roi(risk, D("4000000")), "roi") == [(0.0,)]


def test_scores(nothing):
    scores = scorecard.quality_score(nothing)
    assert sorted(tuples(scores)) == [(t, 0, 0, None, None) for t in ("customers", "orders", "payments")]
    assert tuples(scorecard.global_score(scores)) == [(100.0, 100.0)]
    assert tuples(feeds.percent_with_problems(scores)) == [(0.0,)]
    assert tuples(scorecard.global_score(scores.where("false"))) == [(100.0, 100.0)]


def test_census_and_report(nothing):
    assert [r[1] for r in tuples(checks.null_census(nothing))] == [0] * 5
    lines = {(r["section"], r["metric"]): r["value_text"] for r in report.sectioned_report(nothing).collect()}
    assert lines[(6, "total difference")] == "N/A"
    assert lines[(9, "orders")] == "N/A"
    assert lines[(9, "global")] == "100.00%"
    assert lines[(10, "total")] == "$ 0 COP"
    assert consolidated.error_trend(nothing).count() == 0


def test_true_zero_score_stays_zero(spark):
    ledger = ledger_of(spark, customers=[(1, None, None, day(1))])
    scores = {r["table_name"]: r["score"] for r in scorecard.quality_score(ledger).collect()}
    assert scores == {"customers": 0.0, "orders": None, "payments": None}
    assert tuples(scorecard.global_score(scorecard.quality_score(ledger))) == [(66.67, 0.0)]


def test_all_null_rows(spark):
    ledger = ledger_of(spark, customers=[(1, None, None, None)], products=[(1, "P", D("1.00"), None)],
                       orders=[(1, None, None, None, None, None)], payments=[(1, None, None, None, None)])
    assert tuples(checks.orders_without_customer(ledger), "order_id") == [(1,)]
    assert tuples(checks.orphan_payments(ledger), "payment_id") == [(1,)]
    assert checks.completed_without_payment(ledger).count() == 0
    assert checks.amount_mismatches(ledger).count() == 0
    assert tuples(consolidated.consolidated_view(ledger), "order_id", *consolidated.FLAGS) == [(1, 1, 0, 0, 1, 0)]
    assert sorted(tuples(scorecard.quality_score(ledger), "table_name", "bad")) == [
        ("customers", 1), ("orders", 1), ("payments", 1)]


def test_rounding_is_half_away_from_zero(spark):
    # 1 of 800 is 0.125 %.
    customers = [(i, "n" if i else None, f"e{i}", day(1)) for i in range(800)]
    row = [r for r in scorecard.quality_score(ledger_of(spark, customers=customers)).collect()
           if r["table_name"] == "customers"][0]
    assert (row["pct"], row["score"]) == (0.13, 99.88)


def test_conform_rejects_missing_columns(spark):
    with pytest.raises(SchemaError, match="total_amount"):
        conform(spark.createDataFrame([], "order_id long, customer_id long, product_id long, "
                                          "order_date timestamp_ntz, status string"), "orders")
