"""Physical plans: no Cartesian or nested-loop joins, no Python, pruned scans."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as contract

# Queries that run jobs and return what they wrote have no plan of interest.
JOBS = {"a05_laid_out", "a07_laid_out", "a09_laid_out", "a18_laid_out", "b09_trend_by_day",
        "d04_export_gate", "d04_export_run", "f07_stream_reconciliation", "f08_daily_scorecard", "f08_incremental_scorecard",
        "f10_stream_absences", "f10_stream_unpaid"}
PLANNED = [name for name in contract.queries() if name not in JOBS and not name.startswith(("op", "pipeline"))]


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
@pytest.mark.parametrize("name", PLANNED)
def test_plan_is_distributed(spark, sf_small, name, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        plan = plan_of(contract.queries()[name](spark, sf_small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "PythonUDF", "MapInPandas"):
        assert banned not in plan


def scans(plan):
    return re.findall(r"FileScan parquet \[([^\]]*)\]", plan)


def columns_read(plan):
    return {re.sub(r"#\d+L?", "", c) for scan in scans(plan) for c in scan.split(",") if c}


def test_orphan_rate_reads_two_key_columns(spark, sf_small):
    plan = plan_of(contract.queries()["a04_orders_without_customer_rate"](spark, sf_small))
    assert columns_read(plan) == {"o_orderkey", "o_custkey", "c_custkey"}


# The export's listing is read from ranges that its first job wrote: blocks, their numbers by range, and the two joined.
@pytest.mark.parametrize("name, most", [("a01_duplicate_groups", 3), ("a01_duplicate_groups_export", 4),
                                        ("n01_document_duplicates", 1), ("b08_over_under_by_order", 8)])
def test_shuffles_are_few(spark, sf_small, name, most):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(contract.queries()[name](spark, sf_small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"(?<!Broadcast)Exchange ", plan)) <= most


@pytest.mark.parametrize("name, most", [("a09_amount_mismatch", 8), ("a16_inactive_product_orders", 9),
                                        ("a18_consolidated_view", 13), ("b06_problem_rows", 13),
                                        ("b09_error_trend", 11), ("f05_quarantine", 11), ("f06_clean", 11)])
def test_counted_keys_leave_few_shuffles_and_one_scan_of_the_lines(spark, sf_small, name, most):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(contract.queries()[name](spark, sf_small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"(?<!Broadcast)Exchange ", plan)) <= most
    assert sum("l_partkey" in scan for scan in scans(plan)) <= 1


def test_duplicate_rate_is_one_scan(spark, sf_small):
    assert len(scans(plan_of(contract.queries()["a02_duplicate_rate"](spark, sf_small)))) == 1


def test_unpaid_risk_pushes_its_filter_and_skips_names(spark, sf_small):
    plan = plan_of(contract.queries()["a06_completed_without_payment_risk"](spark, sf_small))
    assert "EqualTo(o_orderstatus,F)" in plan or "o_orderstatus" in plan
    assert columns_read(plan) == {"o_orderkey", "o_orderstatus", "o_totalprice"}
    assert "LeftAnti" in plan


@pytest.mark.parametrize("name", ["a11_revenue_at_risk", "b01_revenue_at_risk_total", "b05_risk_by_category",
                                  "b10_order_vs_paid", "c01_risk_shares", "c04_fix_roi"])
def test_risk_needs_no_other_tables(spark, sf_small, name):
    read = columns_read(plan_of(contract.queries()[name](spark, sf_small)))
    assert not {c for c in read if c.startswith(("c_", "p_", "l_"))}


def test_cards_need_no_order_lines_and_the_report_reads_them_once(spark, sf_small):
    assert "l_partkey" not in plan_of(contract.queries()["b04_kpi_cards"](spark, sf_small))
    report = scans(plan_of(contract.queries()["d06_sectioned_report"](spark, sf_small)))
    assert sum("l_partkey" in scan for scan in report) == 1


def test_report_scans_each_table_a_fixed_number_of_times(spark, sf_small):
    """Customers once by email and once as keys, however many figures are reported."""
    plan = plan_of(contract.queries()["d06_sectioned_report"](spark, sf_small))
    customers = [s for s in scans(plan) if "c_custkey" in s]
    assert len(customers) == 2


def test_details_are_not_sorted(spark, sf_small):
    plan = plan_of(contract.queries()["a09_amount_mismatch"](spark, sf_small))
    assert "rangepartitioning" not in plan
