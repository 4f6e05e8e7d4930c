"""Orders and payments as streams: both absences, sums at the deadline, bounded state, late rows set aside."""

from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from fixture import tuples

from ledgersift.model import ROLE_SCHEMAS
from ledgersift.streaming.gate import pass_in_time, passed, side_output
from ledgersift.streaming.reconciled import NO_ORDER, NO_PAYMENT, absences, append_rows, closed_orders

DDL = {role: ROLE_SCHEMAS[role].simpleString()[7:-1].replace(":", " ") for role in ("orders", "payments")}
DAY0 = datetime(2024, 1, 1)


def at(day, hour=0):
    return DAY0 + timedelta(days=day, hours=hour)


def arrive(spark, folder, orders=(), payments=()):
    for role, rows in (("orders", orders), ("payments", payments)):
        spark.createDataFrame(list(rows), ROLE_SCHEMAS[role]).coalesce(1).write.mode("append").parquet(f"{folder}/{role}")


def streams(spark, folder, files=100):
    return [spark.readStream.schema(ROLE_SCHEMAS[role]).option("maxFilesPerTrigger", files).parquet(f"{folder}/{role}")
            for role in ("orders", "payments")]


ORDERS = [
    (1, 1, 1, at(0, 5), "Completed", D("100.00")),   # paid in two parts, one on its own day before the hour
    (2, 1, 1, at(1, 5), "Completed", D("100.00")),   # paid one day too late
    (3, 1, 1, at(2), "Completed", D("50.00")),       # paid on its last day, too much
    (4, 1, 1, at(3), "Pending", D("70.00")),         # no payment, not due
    (5, 1, 1, at(3), "Completed", None),             # no total
    (6, 1, 1, at(4), "Completed", D("10.00")),       # a failed payment only
    (7, 1, 1, at(60), "Completed", D("10.00")),      # still open at the end
    (8, 1, 1, None, "Completed", D("33.00")),        # undated
    (9, 1, 1, at(5), "Completed", D("0.00")),        # nothing to pay
    (20, 1, 1, at(90), "Pending", D("1.00")), (21, 1, 1, at(91), "Pending", D("1.00")),
]
PAYMENTS = [
    (1, 1, at(0, 1), D("60.00"), "Paid"), (2, 1, at(7, 9), D("40.00"), "Paid"), (3, 2, at(32), D("100.00"), "Paid"),
    (4, 3, at(32, 23), D("55.00"), "Paid"), (5, 6, at(5), D("10.00"), "Failed"), (6, 77, at(9, 1), D("5.00"), "Paid"),
    (7, 77, at(9, 2), D("6.00"), "Paid"), (8, 77, at(10), None, "Pending"), (9, None, at(3), D("8.00"), "Paid"),
    (10, 78, None, D("9.00"), "Paid"), (11, 79, at(80, 3), D("2.00"), "Paid"), (30, 20, at(90), D("1.00"), "Paid"),
    (31, 21, at(92), D("1.00"), "Paid"),
]


def test_both_absences_from_one_query(spark, tmp_path):
    arrive(spark, tmp_path / "in", ORDERS, PAYMENTS)
    append_rows(absences(*streams(spark, tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = set(tuples(spark.read.parquet(str(tmp_path / "out"))))
    assert got == {
        (NO_PAYMENT, 2, at(1), 0, D("100.00")), (NO_PAYMENT, 5, at(3), 0, None), (NO_PAYMENT, 9, at(5), 0, D("0.00")),
        (NO_PAYMENT, 8, None, 0, D("33.00")), (NO_ORDER, 2, at(32), 1, D("100.00")),
        (NO_ORDER, 77, at(9), 2, D("11.00")), (NO_ORDER, 77, at(10), 1, None), (NO_ORDER, None, at(3), 1, D("8.00")),
        (NO_ORDER, 78, None, 1, D("9.00")), (NO_ORDER, 79, at(80), 1, D("2.00"))}


def test_orders_are_closed_at_their_deadline(spark, tmp_path):
    """Three runs: nothing is told before its time, and each order once."""
    for k, (low, high) in enumerate([(0, 5), (5, 40), (40, 100)]):
        arrive(spark, tmp_path / "in", [o for o in ORDERS if o[3] and low <= (o[3] - DAY0).days < high],
               [p for p in PAYMENTS if p[2] and low <= (p[2] - DAY0).days < high])
        query = append_rows(closed_orders(*streams(spark, tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
        query.awaitTermination()
        if k == 0:
            assert spark.read.parquet(str(tmp_path / "out")).count() == 0
    got = tuples(spark.read.parquet(str(tmp_path / "out")), "order_id", "n_payments", "paid_total", "diff", "diff_type")
    assert sorted(got) == [(2, 0, D("0.00"), D("-100.00"), "Underpaid"), (3, 1, D("55.00"), D("5.00"), "Overpaid"),
                           (6, 0, D("0.00"), D("-10.00"), "Underpaid"), (7, 0, D("0.00"), D("-10.00"), "Underpaid")][:3]


def test_nothing_is_told_before_the_watermark_is_later(spark, tmp_path):
    """The watermark ends at day 90: an order's 30 days end there for day 59, a payment's day for day 89."""
    orders = [(k, 1, 1, at(k), "Completed", D("5.00")) for k in (57, 58, 59, 60)]
    arrive(spark, tmp_path / "in", [*orders, (91, 1, 1, at(91), "Pending", D("1.00"))],
           [(k, 1_000 + k, at(k, 3), D("1.00"), "Paid") for k in (87, 88, 89, 90)] + [(200, 91, at(91), D("1.00"), "Paid")])
    for plan, told in ((absences, {57, 58, 1_087, 1_088}), (closed_orders, {57, 58})):
        out = str(tmp_path / plan.__name__)
        append_rows(plan(*streams(spark, tmp_path / "in")), out, f"{out}-state").awaitTermination()
        assert {r.order_id for r in spark.read.parquet(out).collect()} == told


@pytest.mark.parametrize("plan", [absences, closed_orders])
def test_an_order_paid_very_often_holds_a_row_a_day(spark, tmp_path, plan):
    n = 100_000
    paid = (spark.range(n).selectExpr("id AS payment_id", "7L AS order_id", "timestamp_ntz'2024-01-01 00:00:00' "
            "+ make_dt_interval(CAST(id % 5 AS INT), 0, CAST(id % 60 AS INT)) AS payment_date",
            "CAST(1 AS DECIMAL(12,2)) AS payment_amount", "'Paid' AS payment_status"))
    paid.coalesce(2).write.parquet(str(tmp_path / "in" / "payments"))
    spark.createDataFrame([(7, 1, 1, at(0), "Completed", D("1.00")), (8, 1, 1, at(4), "Completed", D("1.00"))],
                          ROLE_SCHEMAS["orders"]).write.parquet(str(tmp_path / "in" / "orders"))
    query = append_rows(plan(*streams(spark, tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination()
    held = [op.numRowsTotal for p in query.recentProgress for op in p.stateOperators]
    assert held and max(held) <= 12


def test_late_rows_are_set_aside_and_not_lost(spark, tmp_path):
    source, gate = tmp_path / "in", str(tmp_path / "gate")

    def split():
        orders, payments = streams(spark, source)
        pass_in_time({"orders": (orders, "order_date"), "payments": (payments, "payment_date")}, gate,
                     lateness=timedelta(days=1)).awaitTermination()

    arrive(spark, source, [(1, 1, 1, at(10), "Completed", D("1.00"))], [(1, 1, at(12), D("1.00"), "Paid")])
    split()
    arrive(spark, source, [(2, 1, 1, at(9), "Completed", D("1.00")), (3, 1, 1, at(8, 23), "Completed", D("1.00")),
                           (4, 1, 1, None, "Completed", D("1.00"))],
           [(2, 3, at(2), D("1.00"), "Paid"), (3, 1, at(30), D("1.00"), "Paid")])
    split()
    arrive(spark, source, [(5, 1, 1, at(40), "Completed", D("1.00"))], [(4, 1, at(9), D("1.00"), "Paid")])
    split()

    def ids(kind, role, key):
        return sorted(tuples(side_output(spark, gate, kind, role, DDL[role]), key, "batch"))

    # The clock stands at the stream that is furthest behind: day 10 less a day, the same after the second batch.
    assert ids("late", "orders", "order_id") == [(3, 1)] and ids("undated", "orders", "order_id") == [(4, 1)]
    assert ids("late", "payments", "payment_id") == [(2, 1)]
    assert ids("in_time", "orders", "order_id") == [(1, 0), (2, 1), (5, 2)]
    assert ids("in_time", "payments", "payment_id") == [(1, 0), (3, 1), (4, 2)]
    orders, payments = (passed(spark, gate, role, DDL[role]) for role in ("orders", "payments"))
    append_rows(closed_orders(orders, payments, within=5), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert tuples(spark.read.parquet(str(tmp_path / "out")), "order_id", "diff") == [(2, D("-1.00"))]
