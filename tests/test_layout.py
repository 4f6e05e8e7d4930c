"""A ledger laid out for its joins: the same results as the plain one, and joins without exchange."""

import re
from collections import Counter

import pytest
from fixture import ledger_of, tuples
from test_invariants import random_rows
from test_plans import plan_of

from ledgersift.operators.facts import settlements
from ledgersift.operators.skew import SkewPolicy
from ledgersift.plans import checks, consolidated, scorecard
from ledgersift.sources.layout import laid_out, laid_out_paid_orders, laid_out_settlements, lay_out

CHECKS = {"a05": checks.completed_without_payment, "a07": checks.orphan_payments, "a09": checks.amount_mismatches,
          "a10": checks.amount_mismatch_summary, "a11": scorecard.revenue_at_risk, "a12": scorecard.quality_score,
          "a18": consolidated.consolidated_view, "b10": consolidated.order_vs_paid}


def random_ledger(spark, seed, policy):
    rows = random_rows(seed)
    rows["orders"] += [(3, 90, 1, None, "Completed", None)]  # a repeated id
    return ledger_of(spark, **rows, skew=policy)


@pytest.mark.parametrize("seed, policy", [(1, SkewPolicy()), (2, SkewPolicy(rows_per_task=5, max_hot_keys=4))])
def test_same_results(spark, tmp_path, seed, policy):
    ledger = random_ledger(spark, seed, policy)
    layout = lay_out(ledger, f"same_{seed}", str(tmp_path), buckets=3)
    other = laid_out(ledger, layout)
    columns = ["order_id", "payment_id", "paid_order_id", "order_found", "payment_found", "total_amount"]
    assert Counter(tuples(other.settled, *columns)) == Counter(tuples(settlements(ledger), *columns))
    for name, check in CHECKS.items():
        assert Counter(tuples(check(other))) == Counter(tuples(check(ledger))), name


def test_joins_without_exchange(spark, tmp_path):
    ledger = random_ledger(spark, 1, SkewPolicy())
    layout = lay_out(ledger, "plain", str(tmp_path), buckets=3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (laid_out_settlements(layout, spark), laid_out_paid_orders(layout, spark)):
            plan = plan_of(df)
            assert "SortMergeJoin" in plan and not re.findall(r"Exchange hashpartitioning\((?:paid_)?order_id", plan)
        for check in (checks.orphan_payments, scorecard.revenue_at_risk, checks.amount_mismatch_summary):
            plan = plan_of(check(laid_out(ledger, layout)))
            assert "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_rows(spark, tmp_path):
    ledger = ledger_of(spark)
    other = laid_out(ledger, lay_out(ledger, "nothing", str(tmp_path), buckets=2))
    assert consolidated.consolidated_view(other).count() == 0 == checks.orphan_payments(other).count()
